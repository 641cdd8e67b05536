import hashlib
import re

from .util import EDGE, docs

KINDS = ["email", "ip", "card", "phone"]


def luhn(d):
    v = [int(x) for x in d[::-1]]
    return sum(x if i % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for i, x in enumerate(v)) % 10 == 0


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    "mail a.b+c@x-y.co.uk, then d@e.f_g@h.i and x@y no; .@-.-",
    "é\U0001f600 10.0.0.255 300.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.4",
    "card 4111 1111-1111 1111, 4242424242424242 and 4242424242424241; +1 (604) 555-8016",
    "+49 30 901820 +1-2 +1 (212) 555-0199 x +442071838750.",
    "1 " * 300,
    "12.5 " * 40 + "8.8.8.8",
    "9" * 20000,
    "a" * 20000 + "@b",
    "call (604) 555-8016 or jo (at) example (dot) org on 2024-01-05 at 12:30:45",
    "a@b.c " * 200,
]


def test_pii(spark):
    from rulemill.llm.pii import pii_spans, redacted

    texts = [*EDGE, *TEXTS]
    got = {r.doc_id: r for r in pii_spans(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[1] for x in want) for k in range(4)], (i, t and t[:80], want)
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    added = got[len(EDGE) + 8]
    assert added.n_added == 2 and "phone:5:19" in added.spans, added
    assert not got[len(EDGE) + 6].n_added
    red = {r.doc_id: r.text for r in redacted(docs(spark, texts)).collect()}
    assert red[len(EDGE) + 3] == "[PHONE] +1-2 [PHONE] x [PHONE]." and red[0] is None and red[1] == ""
    assert red[len(EDGE)] == "mail [EMAIL], then [EMAIL][EMAIL] and x@y no; [EMAIL]"
    assert pii_spans(docs(spark, [])).count() == 0


def brute_added(t):
    """Candidates one by one: generators, features, trees and thresholds in plain Python, without the columns."""
    import regex

    from rulemill.llm.pii import LEAST_DIGITS, PROPOSED
    from rulemill.llm.pii_model import features, model, score

    taken = [(s, e) for s, _, e in brute(t)]
    out = []
    for kind, pattern in PROPOSED:
        trees, cut = model(kind)
        last, now = 0, []
        for m in regex.finditer(pattern, t):
            s, e, context = m.start(), m.end(), t[last : m.start()][-24:]
            last = e
            if sum(c in "0123456789" for c in m[0]) < LEAST_DIGITS.get(kind, 0) or any(s < b and a < e for a, b in taken):
                continue
            if score(trees, features(context, m[0])) >= cut:
                now.append((s, KINDS.index(kind), e))
        taken += [(s, e) for s, _, e in now]
        out += now
    return sorted(out)


def test_added_spans_equal_brute_force(spark):
    import random

    from rulemill.llm.pii import personal_data, redacted
    from rulemill.llm.pii_model import KINDS as kinds
    from rulemill.llm.pii_model import examples

    rnd = random.Random(6)
    made = [(c, m) for k in kinds for part, c, m, _ in examples(k) if part == 2]
    texts = ["".join(f"{c}{m}{rnd.choice([' and ', ', ', chr(10), '. é '])}" for c, m in rnd.sample(made, 12)) for _ in range(60)]
    texts += ["hotel 604 555 8016", "604 555 8016", "order 604 555 8016", "call 604 555 8016 now", "a" * 70 + "ü@" + "b" * 90 + ".org, x", "x (at) y" + ".z" * 40, "12 " * 400, *TEXTS]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in personal_data(d).collect()}
    red = {r.doc_id: r.text for r in redacted(d).collect()}
    n = 0
    for i, t in enumerate(texts):
        want = brute_added(t)
        assert [(x.s, x.k, x.e) for x in got[i].added] == want, (t[:200], want, got[i].added)
        n += len(want)
        out, at = "", 0
        for s, k, e in sorted(brute(t) + want):
            out += t[at:s] + f"[{KINDS[k].upper()}]" if s >= at else ""
            at = max(at, e)
        assert red[i] == out + t[at:]
    assert n > 200 and got[60].added and got[61].added and not got[62].added and got[63].added
    assert [(x.s, x.e) for x in got[64].added] == [(0, len(texts[64]) - 3)]


def test_held_out_candidates():
    """Precision and recall on the part of the labelled candidates that neither trees nor thresholds have seen."""
    from rulemill.llm.pii_model import examples, features, model, score

    for kind in KINDS:
        trees, cut = model(kind)
        rows = [(score(trees, features(c, m)) >= cut, y) for part, c, m, y in examples(kind) if part == 2]
        right = sum(a and y for a, y in rows)
        assert right >= 0.97 * sum(a for a, _ in rows) and right >= 0.9 * sum(y for _, y in rows), kind


def test_long_log(spark):
    """Thousands of addresses and numbers in one line, and the same in lines."""
    import time

    from rulemill.llm.pii import pii_spans, redacted

    line = "10.1.{0}.7 user{0}@mail.example.org call 604-555-{1:04d} at 2024-01-05 12:30:45 id {0}4111 1111 1111 1111 "
    log = "".join(line.format(i % 250, i % 10000) for i in range(3000))
    began = time.perf_counter()
    rows = pii_spans(docs(spark, [log, log.replace("call", "\ncall")])).collect()
    assert all(r.n_email == 3000 and r.n_ip == 3000 and r.n_added >= 3000 for r in rows) and len(log) > 300_000
    text = redacted(docs(spark, [log])).collect()[0].text
    assert text.count("[EMAIL]") == 3000 and text.startswith("[IP] [EMAIL] call [PHONE] at 2024-01-05 12:30:45 id ")
    assert time.perf_counter() - began < 150


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    from rulemill.llm.pii import personal_data, redacted

    names = ["_t", "_all", "_email", "row", "_p0", "_m", "_chunks"]
    d = docs(spark, ["me@x.org", None]).withColumns({n: F.lit(n) for n in [*names, "base", "added"]})
    for r in personal_data(d).collect():
        assert all(r[n] == n for n in names) and len(r.base) == (r.doc_id == 0) and r.added == []
    assert [(r.text, r.base) for r in redacted(d).orderBy("doc_id").collect()] == [("[EMAIL]", "base"), (None, "base")]


def test_native_plan(spark):
    from rulemill.llm.pii import pii_spans

    plan = pii_spans(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
