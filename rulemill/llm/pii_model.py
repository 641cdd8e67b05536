"""Gradient-boosted trees for candidate spans, trained on labelled candidates and compiled to SQL columns.

The labelled candidates are made from the tables of formats and contexts below (``examples``). They are dealt into three
parts by format: trees are fitted on the first, each kind's threshold is calibrated on the second (the least score that
keeps ``PRECISION`` there), and the third is left for tests. Training runs once on the driver; scoring is a Catalyst
expression.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
import regex

KINDS = ("email", "ip", "card", "phone")
#: Formats of candidates by kind. # is a digit, @ a letter, ! a word, L digits that pass Luhn; 1 after the
#: bar says that the format alone tells personal data, 0 that it is none, ? that the words before it decide.
FORMATS = {
    "email": (
        "!.! (at) ! (dot) @@@|1", "!(at)!.@@|1", "! [at] ! [dot] @@|1", "!{at}!.@@@|1", "!.@ {at} !.! {dot} @@@|1", "!## [at] !-!.@@|1", "! (at) !.@@@|1", "!_! [at] ! (dot) ! (dot) @@|1",
        "é!@!.@@|1", "!ü!.!ß@!.@@|1", "@'!@!.@@@|1", "ñ!.!@!.!.@@|1", "!#ö@!-!.@@@|1", "ç!@!é.@@|1", "!@é!.@@|1", "ä!+!@!.@@@|1", "!/!@!.@@|1", "!=!@!.!.@@|1",
        "(at)!|0", "! (at) !|0", "! (at) ##|0", "!@!|0", "!@é|0", "#@#|0", "!@##|0", "é@!|0", "é!@#|0", "@@@@|0", "! [at] !|0", "!{at}#|0", "ü@ü|0", "##é@##|0", "é!@!..|0", "@é!@@|0",
    ),
    "ip": (
        "2001:db8:85a3:0:0:8a2e:370:####|1", "fe80::1ff:fe##:####:890a|1", "2001:db8::ff##:42:8###|1", "fd##:####:789a:1::1|1", "2606:####:####::1###|1", "2a0#:####:a:b:c:d:e:f|1", "fe80::####:abff:fe##:cd##|1", "::ffff:c0a#:##ff|1",
        "2400:cb0#:20##:1::c629:d7a2|1", "fc##::####:abcd|1", "2607:f8b0:40##:80a::200e|1", "2001:4860:48##::88##|1",
        "##:##:##|0", "#:##:##|0", "#:#:#|0", "##:#:#:#|0", "::#|0", "#:##:##:#|0", "##:##:##:##|0", "###:##:#|0", "#:#:#:#:#|0", "a:b:c|0", "c:d:##|0", "##:##::##|0", "#::#|0", "####:##:##|0", "##:##:##:##:##:##|0",
    ),
    "card": (
        "L16 4.4.4.4|1", "L16 4  4  4  4|1", "L15 4.6.5|1", "L16 4- 4- 4- 4|1", "L15 4  6  5|1", "L16 4 .4 .4 .4|1", "L14 4.6.4|1", "L16 4. 4. 4. 4|1", "L19 6.13|?", "L16 8.8|?", "L13 13|?", "L13 4 9|?", "L13 1.3.3.3.3|?", "L16 2.2.2.2.2.2.2.2|?",
        "N16 4.4.4.4|0", "N16 16|0", "N16 4 4 4 4|0", "N15 4.6.5|0", "N13 3-1-2-6-1|0", "N18 8.6.4|0", "N15 1.14|0", "N17 17|0", "N19 10 9|0", "N24 4 4 4 4 4 4|0", "L24 4 4 4 4 4 4|0", "N30 30|0", "L32 8-8-8-8|0", "L20 10.10|0", "N40 2 2 2 2 2 2 2 2 2 2 2 2 2 2 2 2 2 2 2 2|0",
    ),
    "phone": (
        "(###) ###-####|1", "(###)###-####|1", "###-###-####|1", "###.###.####|1", "(###) ### ####|1", "(###) ###.####|1", "### ### ####|1", "(0##) ### ####|1", "00## ### ### ####|1", "00## ## ######|1", "(0###) ######|1",
        "0## ##### ####|?", "0#### ######|?", "0# ## ## ## ##|?", "0###/######|?", "## ### ## ## ##|?", "### ######|?", "###-####|?", "##########|?", "0##########|?", "### ## ## ##|?", "####-######|?", "## #### ####|?", "#### ####|?", "0##-#######|?",
        "####-0#-1#|0", "1#/0#/20##|0", "0#.1#.19##|0", "19##-20##|0", "########|0", "#######|0", "# ### ###|0", "## ### ###|0", "#.#######|0", "#-###-#####-#|0", "#.#.#.#.##|0", "####-0#-1# 1#|0", "#####-#####|0", "##.##.##|0", "####-####-####-####|0",
        "################|0", "######################|0", "## ## ## ## ## ## ## ## ## ## ##|0", "# # # # # # # # # #|0", "1##.###.###|0", "#.# #.# #.# #.#|0", "## ## ##|0", "1.###.###.###|0", "###/###|0",
    ),
}
#: Words before a candidate, and the kind that they speak for ("other": something else).
WORDS = {
    "phone": "tel phone call fax mobile telefon téléphone ring anruf llame dial cell handy móvil telephone".split(),
    "card": "card visa amex mastercard carte karte tarjeta creditcard".split(),
    "other": "order invoice isbn version id serial section value pages rows dated number ref code sum total population between year since".split(),
}
#: Words that may stand between such a word and the candidate.
LINKS = "al|at|me|us|my|no|nr|is|with|on|by|to|under|unter|au|a"
CONTEXT = {k: rf"(?:^|[^\p{{L}}])(?:{'|'.join(w)})[^\p{{L}}\p{{N}}]*(?:(?:{LINKS})[^\p{{L}}\p{{N}}]+){{0,2}}$" for k, w in WORDS.items()}
DATE = r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})([ T][0-9]{1,2})?$"
MARK = r"\((at|dot)\)|\[(at|dot)\]|\{(at|dot)\}"
LAYOUT = r"^\(?[0-9]{3}\)? ?[-. ]?[0-9]{3}[-. ][0-9]{4}$"  # three, three and four digits
TRUNK = r"^\(?0"
DOMAIN = r"(?:@|[)\]}]) ?[^ @.]+(?:\.[^ @.]+|.*dot.*)$"
FEATURES = ("digits", "length", "groups", "longest", "seps", "dots", "colons", "letters", "parens", "marks", "luhn", "date", "layout", "trunk", "domain", *(f"ctx_{k}" for k in CONTEXT))
TREES, RATE, DEPTH, PRECISION = 16, 0.5, 3, 0.99
COPIES = 6  # of each format and context
NEUTRAL = ("", "the ", "hotel ", "and then ", "cardinal ", "about ", "we saw ", "ordering ", "at ")


def luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return int(bool(digits) and total % 10 == 0)


def _filled(form: str, rnd: random.Random) -> str:
    """One candidate of a format."""
    if form[0] in "LN":
        head, shape = form[1:].split(" ", 1)
        digits = "".join(rnd.choices("0123456789", k=int(head)))
        digits = next(d for d in (digits[:-1] + c for c in "0123456789") if luhn(d) == (form[0] == "L"))
        out, at = "", 0
        for x in regex.split(r"(\d+)", shape):
            out += digits[at : at + int(x)] if x.isdigit() else x
            at += int(x) if x.isdigit() else 0
        return out
    make = {"#": lambda: rnd.choice("0123456789"), "!": lambda: "".join(rnd.choices("abcdefghiklmnoprstuw", k=rnd.randint(2, 9)))}
    out = "".join(make[c]() if c in make else c for c in form)
    return regex.sub("(?<![^ ()])@(?=@|$|')|(?<=@)@|(?<=[. }])@(?=@)", lambda m: rnd.choice("abcdefghi"), out) if "@@" in form or form.startswith("@") else out


def examples(kind: str) -> list[tuple[int, str, str, int]]:
    """(part, context, candidate, label): part 0 for fitting, 1 for calibration, 2 for tests."""
    rnd, out = random.Random(KINDS.index(kind) + 17), []
    sure = {"0": 0, "1": 1}
    for i, line in enumerate(FORMATS[kind]):
        form, label = line.rsplit("|", 1)
        for c in range(COPIES):
            said = [(rnd.choice(NEUTRAL), sure.get(label, 0))]
            for k, w in WORDS.items():
                word = rnd.choice(w) + rnd.choice([" ", ": ", " is ", ". "])
                fits = kind in ("phone", "card") and k == kind
                said.append((word, sure.get(label, int(fits)) if k != "other" or label == "0" else int(kind not in ("phone", "card") and label == "1")))
            out += [((i + c) % 3, context, _filled(form, rnd), y) for context, y in said]
    return out


def features(context: str, m: str) -> list[float]:
    """The same values as ``pii.feature_columns``, for training."""
    digits = regex.sub("[^0-9]", "", m)
    runs = [len(x) for x in regex.split("[^0-9]+", m) if x]
    return [
        len(digits),
        len(m),
        len(runs),
        max(runs, default=0),
        len(m) - len(regex.sub(r"[ ./-]", "", m)),
        m.count("."),
        m.count(":"),
        len(regex.sub("[^A-Za-z]", "", m)),
        m.count("(") + m.count(")"),
        len(regex.findall(MARK, m)),
        luhn(digits),
        *(int(bool(regex.search(p, m))) for p in (DATE, LAYOUT, TRUNK, DOMAIN)),
        *(int(bool(regex.search(p, context.lower()))) for p in CONTEXT.values()),
    ]


def _tree(x, grad, hess, at, depth):
    """Greedy regression tree by second-order gain: a leaf value or (feature, cut, low, high)."""
    g, h = grad[at].sum(), hess[at].sum()
    best = None
    if depth:
        for f in range(x.shape[1]):
            order = at[np.argsort(x[at, f], kind="stable")]
            v = x[order, f]
            edge = np.flatnonzero(v[1:] != v[:-1])
            if not len(edge):
                continue
            gl, hl = np.cumsum(grad[order])[edge], np.cumsum(hess[order])[edge]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
                best = (gain[i], f, float(v[edge[i]] + v[edge[i] + 1]) / 2)
    if best is None:
        return float(g / (h + 1))
    _, f, cut = best
    low = x[at, f] <= cut
    return f, cut, _tree(x, grad, hess, at[low], depth - 1), _tree(x, grad, hess, at[~low], depth - 1)


def tree_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def score(trees, row) -> float:
    return sum(RATE * tree_value(t, row) for t in trees)


@lru_cache(None)
def model(kind: str) -> tuple[list, float]:
    """The kind's trees, and its threshold: the least score at which the calibration part keeps the wanted precision."""
    rows = examples(kind)
    x = np.array([features(c, m) for p, c, m, _ in rows if p == 0], float)
    y = np.array([v for p, _, _, v in rows if p == 0], float)
    total, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(_tree(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH))
        total += [RATE * tree_value(trees[-1], r) for r in x]
    held = sorted(((score(trees, features(c, m)), v) for p, c, m, v in rows if p == 1), reverse=True)
    cut, good = math.inf, 0
    for i, (s, v) in enumerate(held):
        good += v
        if good >= PRECISION * (i + 1) and (i + 1 == len(held) or held[i + 1][0] < s):
            cut = (s + held[i + 1][0]) / 2 if i + 1 < len(held) else s
    return trees, max(0.0, float(cut))
