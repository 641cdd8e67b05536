import itertools
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from rulemill.functions import json as J
from rulemill.functions import paths, text, vectors
from rulemill.operators import components, discovery, evaluation, graph, reasoning, relational, retrieval


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c.alias("x")).first().x


def test_paths(spark):
    p = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert p(paths.section_prefix, "4.1", "4.1.2") and not p(paths.section_prefix, "4.1", "4.10") and p(paths.subject_prefix, "a.b.c", "a.b") and not p(paths.subject_prefix, "a.bc", "a.b")
    assert [p(paths.path_relation, "a.b", x) for x in ("a.b", "a.b.c", "a.c", "d")] == ["SAME", "REFINEMENT", "DISJOINT", "INCOMPARABLE"]
    assert one(spark, paths.ancestors(F.col("a")), a="1.2.3") == ["1", "1.2", "1.2.3"]
    assert one(spark, paths.version_vector(F.col("a")), a="v2.10") == [2, 10, 0, 0, 0, 0]


def test_text(spark):
    t = lambda f, a: one(spark, f(F.col("a")), a=a)
    assert t(text.keywords_in, "A MUST  NOT b and SHALL c, must d") == ["MUST NOT", "SHALL"]
    assert t(text.sentences_of, "One. Two!  Three?\n\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert t(text.requirements_of, "CAs MUST a; they MUST b and SHALL c") == ["CAs MUST a", "they MUST b", "SHALL c"]
    assert [(e.kind, e.clause) for e in t(text.exceptions_of, "MUST be set unless the CA is a root.")] == [("unless", "the CA is a root")]
    assert [(r.kind, r.target) for r in t(text.references_of, "see Section 4.2 of RFC 5280 and EN 319 412-2")] == [("rfc_section", "5280#4.2"), ("rfc", "5280"), ("etsi", "319 412-2"), ("section", "4.2")]
    assert t(text.first_number, "at most 39.5 months") == 39.5 and t(text.first_number, "none") is None
    assert t(text.slug, " A b--C! ") == "a_b_c" and t(text.token_estimate, "12345") == 2 and str(t(text.free_date, "3 May 2021")) == "2021-05-03" and t(text.free_date, "soon") is None
    assert t(text.tokens_of, "The big cat, an ox") == ["big", "cat"] and one(spark, text.literal_ilike(F.col("a"), "50%_X"), a="is 50%_x here")
    assert one(spark, text.canonical_keyword(F.col("a")), a="SHALL NOT") == "MUST NOT" and one(spark, text.snippet(F.col("a"), 3), a="abcd") == "abc..."


def test_json_and_vectors(spark):
    rows = spark.createDataFrame([('{"ir": {"subject": {"path": "a.b"}, "obligation": "MUST", "lintable": true}}',), ('{"ir": {"subject": "c"}}',), ("broken",)], "ir_data string")
    got = J.generated(rows).collect()
    assert [(r.subject, r.obligation, r.lintable) for r in got] == [("a.b", "MUST", True), ("c", None, False), (None, None, False)]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(r.c, 6) for r in v] == [0.707107, 0.0]
    h = one(spark, vectors.hash_vector(F.col("a")), a="x")
    assert len(h) == 32 and abs(sum(x * x for x in h) - 1) < 1e-9


def test_relational(spark):
    assert relational.expand_terms(["urgent"], {"urgent": ["top priority", "asap"]}) == ["urgent", "top priority"]
    a = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k int, v int")
    assert sorted(r.v for r in relational.anti(a, a.where("k = 1"), ["k"]).collect()) == [1, 3]
    page = relational.search(spark.createDataFrame([(i, "Term %") for i in range(5)], "id int, t string"), ["t"], ["term %"], None, [F.col("id")], 9, 2)
    assert [r.id for r in page.collect()] == [0, 1]
    cat = spark.createDataFrame([("4.1", 7), ("4.1", 3), ("4", 1)], "section string, rule_id int")
    q = spark.createDataFrame([("4.1.2",), ("4.10",), ("5",), ("4.1",)], "section string")
    assert {r.section: r.entry for r in relational.priority_lookup(q, cat, "section", "rule_id").collect()} == {"4.1.2": 3, "4.10": 1, "5": None, "4.1": 3}
    rnd = random.Random(1)
    pts, rgs = [(rnd.uniform(-5, 50),) for _ in range(200)], [(i, lo := rnd.uniform(-5, 40), lo + rnd.uniform(0, 9)) for i in range(40)]
    got = relational.range_join(spark.createDataFrame(pts, "x double"), spark.createDataFrame(rgs, "i int, lo double, hi double"), "x", "lo", "hi", 2.5)
    assert sorted((r.x, r.i) for r in got.collect()) == sorted((x, i) for (x,) in pts for i, lo, hi in rgs if lo <= x <= hi)


def test_positional_and_fuzzy(spark):
    rnd = random.Random(3)
    rows = [(d, i, rnd.choice(["A  b", "a b", "c"])) for d in range(3) for i in range(40)]
    want = []
    for d in range(3):
        last = {}
        for dd, i, t in rows:
            key = " ".join(t.lower().split())
            if dd == d and (key not in last or i - last[key] > 4):
                last[key] = i
                want.append((d, i))
    got = discovery.positional_dedupe(spark.createDataFrame(rows, "d int, i int, t string"), "d", "i", "t", 4)
    assert sorted((r.d, r.i) for r in got.collect()) == sorted(want)
    texts = ["the subject must be set", "the subject must be set.", "serial is positive", "the subject must be sent", None]
    df = spark.createDataFrame([(i, "b", t, 0.5 + i / 10, [f"r{i % 2}"]) for i, t in enumerate(texts)], "id long, blk string, t string, conf double, refs array<string>")
    stars = discovery.fuzzy_merge(df, ["blk"], "id", "t")
    assert SequenceMatcher(None, texts[0], texts[3]).ratio() >= 0.85
    assert {r.id: r.star for r in stars.collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    m = {r.star: (r.id, r.refs) for r in discovery.merged(df, stars, "id", "conf", ["refs"]).collect()}
    assert m[0] == (3, ["r0", "r1"])


def test_sections(spark):
    d = spark.createDataFrame([(1, "intro\n# One\na\nb\n2.1 Two words\nc"), (2, "")], "doc_id int, text string")
    got = [(r.doc_id, r.section_no, r.section_id, r.title, r.text) for r in discovery.sections(d).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, 0, "", "", "intro"), (1, 1, "", "One", "a\nb"), (1, 2, "2.1", "Two words", "c"), (2, 0, "", "", "")]
    p = spark.createDataFrame([(1, i, f"Head\nbody {i}\nPage {i}") for i in range(4)], "d int, p int, t string")
    assert {r.line for r in discovery.repeated_lines(p, "d", "p", "t").collect()} == {"Head", "Page #"}
    assert one(spark, discovery.table_markdown(F.array(F.array(F.lit("a"), F.lit("b|")), F.array(F.lit("1"), F.lit("2")))), a=1) == "| a | b\\| |\n| --- | --- |\n| 1 | 2 |"
    c = discovery.context(spark.createDataFrame([(1, i, str(i)) for i in range(5)], "d int, i int, t string"), "d", "i", "t", 1)
    assert [r.context for r in c.orderBy("i").collect()] == ["0 1", "0 1 2", "1 2 3", "2 3 4", "3 4"]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "r"), (2, 3, "r"), (3, 1, "s"), (3, 4, "r"), (5, 6, "r"), (1, 3, "q")], "src long, dst long, relation string")
    assert {(r.node, r.distance) for r in graph.reachable(e, [1], 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert graph.shortest_path(e, 1, 4, 3).first().path == [1, 3, 4] and not graph.shortest_path(e, 1, 6, 3).head(1) and not graph.shortest_path(e, 1, 4, 0).head(1)
    assert {r.start: r.length for r in graph.strong_cycles(e, [1, 2, 4], 4).collect()} == {1: 2, 2: 3}
    nodes, inner = graph.subgraph(e, [1], 2, most=3)
    assert nodes.count() == 3 and {(r.src, r.dst) for r in inner.collect()} == {(1, 2), (2, 3), (3, 1), (1, 3)}
    assert {r.component for r in components.connected(e).collect()} == {1, 5}
    u = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "term string, used string")
    got = graph.expand_definitions(u.select("term").distinct(), u, 2)
    assert {(r.term, r.used, r.level) for r in got.collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}


def test_cliques(spark):
    rnd = random.Random(2)
    pairs = [(a, b) for a, b in itertools.combinations(range(12), 2) if rnd.random() < 0.5]
    e = spark.createDataFrame(pairs, "src long, dst long")
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    full = [set(c) for k in range(2, 13) for c in itertools.combinations(range(12), k) if all((a, b) in near for a, b in itertools.combinations(c, 2))]
    want = sorted(sorted(c) for c in full if not any(c < d for d in full))
    comp = components.connected(e)
    assert sorted(r.clique for r in graph.maximal_cliques(e, comp).collect()) == want
    assert graph.maximal_cliques(e, comp, most=2).first().clique is None


def test_cliques_of_a_large_component(spark):
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(6000)]  # one component of over 5,000 vertices
    dense = [(a, b) for a, b in itertools.combinations(range(0, 60, 2), 2) if rnd.random() < 0.6]
    hub = [(7000, i) for i in range(0, 400)]
    pairs = set(chain + dense + hub)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = []

    def grow(r, p, x):
        if not p and not x:
            want.append(sorted(r))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    for v in near:  # at its least vertex
        grow({v}, {w for w in near[v] if w > v}, {w for w in near[v] if w < v})
    edges = [*pairs, *[(b, a) for a, b in dense[:20]], *dense[:5], (3, 3)]
    e = spark.createDataFrame(edges, "src long, dst long")
    comp = spark.createDataFrame([(v, 0) for v in near], "node long, component long")
    rows = graph.maximal_cliques(e, comp).collect()
    assert {r.component for r in rows} == {0} and sorted(r.clique for r in rows) == sorted(want)


def test_reasoning(spark):
    rules = spark.createDataFrame(
        [(1, 10, "ext.san", "must_exist", None, 5.0, "CABF-BR", "2020-01-01"), (2, 20, "ext.san", "must_not_exist", 5.0, None, "RFC", "2021-01-01"), (3, 20, "ext.san", "must_not_exist", 6.0, None, "RFC", "2021-01-01"), (4, 10, "ext.san", "must_not_exist", None, None, "CABF-BR", "2020-01-01"), (5, 30, "ext.san.dns", "must_exist", None, None, "X", "2022-01-01")],
        "id int, standard_id int, subject string, predicate string, lo double, hi double, source string, publish_date string",
    )
    pairs = reasoning.conflicts(rules)
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {(1, 2)}
    exc = spark.createDataFrame([(1, "NEGATE", "must_not_exist")], "target_rule_id int, effect string, predicate string")
    assert reasoning.conflicts(rules, exc).count() == 0
    assert [(r.how, r.winner_id) for r in reasoning.resolved(pairs, rules).collect()] == [("source", 1)]
    rel = lambda t: spark.createDataFrame([(20, 10, t)], "source_standard_id int, target_standard_id int, relationship_type string")
    assert [(r.how, r.winner_id) for r in reasoning.resolved(pairs, rules, rel("obsoletes")).collect()] == [("relation", 2)]
    assert [(r.how, r.winner_id) for r in reasoning.resolved(pairs, rules, rel("supplements")).collect()] == [("both", None)]
    got = one(spark, reasoning.value_sets_meet(F.lit("IN"), F.array(F.lit("a")), F.lit("NOT_IN"), F.array(F.lit("a"))), a=1)
    assert got is False
    d = reasoning.dependencies(spark.createDataFrame([("in accordance with RFC 1",), ("see RFC 1",)], "text string")).collect()
    assert [r.relation for r in d] == ["DEPENDS_ON", "CITES"]
    m = reasoning.missing_dimensions(spark.createDataFrame([(None, "x"), ("x", "x")], "a_scope string, b_scope string"), ["scope"]).collect()
    assert [r.is_uncertain for r in m] == [True, False]


def test_evaluation(spark):
    f = spark.createDataFrame([("c1", "l1"), ("c2", "l1"), ("c1", "l2")], "cert string, lint string")
    lints = spark.createDataFrame([("l1", True), ("l2", False)], "lint string, suspect boolean")
    up = spark.createDataFrame([("c1", "l1")], "cert string, lint string")
    t = evaluation.triaged(f, lints, up)
    assert {(r.cert, r.lint): r.verdict for r in t.collect()} == {("c1", "l1"): "REAL", ("c2", "l1"): "SPURIOUS", ("c1", "l2"): "UNCERTAIN"}
    a = evaluation.agreement(spark.createDataFrame([(1, 1)] * 60 + [(1, 0)] * 9 + [(0, 0)] * 37, "t int, s int"), "t", "s").first()
    assert (round(a.agreement, 4), round(a.kappa, 4), a.precision, round(a.recall, 4), round(a.f1, 4)) == (0.9151, 0.8231, 1.0, 0.8696, 0.9302)
    b, c = spark.createDataFrame([(1, "partial"), (2, "full")], "k int, verdict string"), spark.createDataFrame([(1, "full"), (2, "none")], "k int, verdict string")
    assert {r.k: r.verdict for r in evaluation.never_upgraded(b, c, ["k"]).collect()} == {1: "partial", 2: "none"}
    bl = evaluation.blamed(spark.createDataFrame([("The CA MUST do it if asked to", "s", "MUST", None), ("short", "s", "MUST", None), ("The CA SHOULD do that always", "s", "SHOULD", None)], "rule_text string, subject string, obligation string, precondition string"))
    assert [r.blame_stage for r in bl.collect()] == ["precondition", "extraction", "severity"]
    dec = evaluation.candidate_decision(spark.createDataFrame([(12, 0.97), (4, 0.8), (1, 1.0)], "support int, precision double"))
    assert [r.decision for r in dec.collect()] == ["auto", "manual", "rejected"]


def test_versions(spark):
    d = spark.createDataFrame([(1, "A", "Baseline Requirements 1.4.8", "1.4.8"), (2, "A", "Baseline Requirements 2.0", "2.0"), (3, "A", "Other paper", "3"), (4, "B", "Baseline Requirements", "9")], "id int, source string, title string, version string")
    assert [(r.newer_id, r.older_id) for r in retrieval.version_edges(d).collect()] == [(2, 1)]


def test_stream(spark, tmp_path):
    import datetime as dt

    from rulemill.streaming import findings

    start = dt.datetime(2024, 1, 1)
    rows = [(i % 2, "error" if i % 3 == 0 else "pass", start + dt.timedelta(minutes=10 * i), f"c{i // 2}") for i in range(12)]
    spark.createDataFrame(rows, "lint int, status string, ts timestamp_ntz, cert string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lint int, status string, ts timestamp_ntz, cert string").parquet(str(tmp_path / "in"))
    out = findings.firing_by_window(findings.unique_findings(findings.timed(stream), ["lint", "cert"]), "lint", "status")
    q = out.writeStream.outputMode("append").format("memory").queryName("firing").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(fires) f, sum(applies) a from firing where start < '2024-01-01 01:00:00'").first()
    assert (got.f, got.a) == (2, 6)
    s = findings.sessions(findings.timed(spark.createDataFrame(rows, "lint int, status string, ts timestamp_ntz, cert string")), "lint")
    assert s.count() == 2


def test_noise_kept(spark):
    d = discovery.noise_flag(spark.createDataFrame([("ok text that is long enough",), (None,), ("Contents ........ 12",)], "text string"))
    assert [r.is_noise for r in d.collect()] == [False, True, True]
