DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang=None, ids=None):
    rows = [(i if ids is None else ids[i], t, lang[i] if lang else None, None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


#: Nulls, empty and blank texts, ties, repeats, odd code points, a very long text.
EDGE = [None, "", " \n\t ", "a", "a", "A", "b b b b", " x ", "\U0001f600 é ß z", "x" * 30000, "one two three one two three\none two three one two three\n\n", "w " * 5000]
