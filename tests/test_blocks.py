import random
import re

from rulemill.operators import blocks

WS = " \t\r\f\x0b"


def sequential(text):
    """Line by line, with the state carried."""
    out, kind, held = [], None, []

    def flush():
        nonlocal kind, held
        if kind == "r":
            headed = len(held) > 1 and re.search(blocks.RULE, held[1])
            cells = lambda r: [c.replace("\3", "|").strip(" ") for c in re.sub(r"^\||\|$", "", re.sub("[\t\r\f\x0b]", " ", r).strip(" ").replace("\\|", "\3")).split("|")]
            head = cells(held[0]) if headed else []
            for r in held[2:] if headed else held:
                if not re.search(blocks.RULE, r):
                    s = "; ".join(f"{head[i]}: {c}" if i < len(head) and head[i] else c for i, c in enumerate(cells(r)) if c)
                    if s:
                        out.append(("row", s))
        elif kind == "d":
            lines = []
            for line in held:
                if line.strip(WS).startswith("--") and lines and lines[-1][0]:
                    lines[-1][1] += line.strip(WS)[2:]
                else:
                    lines.append([line.strip(WS).startswith("--"), line])
            out.extend(("definition", s) for s in (re.sub(rf"[{WS}]+", " ", x).strip(" ") for _, x in lines) if s)
        elif kind:
            plain = re.sub(r"[ \t\r\n\f\x0b]+", " ", "\n".join(held)).strip(" ")
            cut = [m.end() for m in re.finditer(r"[.!?] ", plain)]
            keep = [c for c in cut if not re.search(r"(^|\W)(e\.g|i\.e|cf|vs|No|Sec|Fig)\. $", plain[:c]) and not re.match(r"(and|or|but)\b", plain[c:])]
            for a, b in zip([0, *keep], [*keep, len(plain)]):
                if plain[a:b].strip(" "):
                    out.append(("item" if kind == "i" else "prose", plain[a:b].strip(" ")))
        kind, held = None, []

    for line in (text or "").split("\n"):
        if not line.strip(WS):
            flush()
        elif re.search(blocks.ROW, line):
            if kind != "r":
                flush()
                kind = "r"
            held.append(line)
        elif re.search(blocks.ITEM, line) or "::=" in line:
            flush()
            kind, held = "i" if re.search(blocks.ITEM, line) else "d", [line]
        else:
            if kind in (None, "r"):
                flush()
                kind = "p"
            held.append(line)
    flush()
    return out


LINES = [
    "", " \t", "| a | b |", "|---|:-:|", "| x \\| y | |  z |", "||", " | q |", "- item one. Two", "(a) letter item", "1. first. and more", "iv) roman",
    "plain text goes. on here e.g. this! But", "  more of it, see No. 5. or not? Yes", "Name ::= SEQUENCE {", "  field INTEGER, -- odd", "-- a comment", "  -- goes on", "}", "1.2.840 is no item. Or is it", "a | b", "é. É",
]


def test_equals_a_state_machine(spark):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice(LINES) for _ in range(rnd.randint(1, 14))) for _ in range(300)] + [None, "", "\n\n", "no end", "| only |", "w. " * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in blocks.sentences(d, ["id"]).orderBy("id", "sentence_index").collect():
        got.setdefault(r.id, []).append((r.kind, r.sentence))
    for i, t in enumerate(texts):
        assert got.get(i, []) == sequential(t), t


def test_table(spark):
    t = "Fields:\n| Name | Must |\n|---|---|\n| subject | yes |\n| issuer | |\nAfter it."
    got = [(r.kind, r.sentence) for r in blocks.sentences(spark.createDataFrame([(1, t)], "id int, text string"), ["id"]).orderBy("sentence_index").collect()]
    assert got == [("prose", "Fields:"), ("row", "Name: subject; Must: yes"), ("row", "Name: issuer"), ("prose", "After it.")]


def test_no_exchange(spark):
    d = spark.createDataFrame([(1, "a")], "id int, text string")
    plan = blocks.sentences(d, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
