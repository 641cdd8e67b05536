"""Main text of web pages: flat blocks with the word counts and link densities of their neighbours, classified by a
decision tree that is trained on the small table of labelled blocks below.

What a block says of itself (words, share of words in links, heading) and of its neighbours stands beside shallow
markup: whether it lies in an article or in a menu, header, footer, sidebar or form, and how strongly a class name hints
at something else. No feature decides alone but by what the tree learned from the table.

Nulls: null or empty html has no blocks and gives the empty text; a null url stays null. Broken markup is read as far
as it goes; very long pages are read whole. Repeated rows are extracted each; an empty table gives no rows; other
columns, whatever their names, are ignored. Ties: of splits with equal impurity the first feature and the lowest cut
win; a leaf with as many blocks of each kind leaves its block out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, small_batches
from .html_blocks import Block, blocks_of

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "article", "boiler", "hint", "heading", "page_article")
#: Labelled pages, one a line, block by block: words, :link density in percent (0 if not said), flags
#: (a in an article, m in a main part, b in a menu, header, footer, sidebar or form, w weak hint, h strong hint, t heading), + for main text.
LABELLED = """
    1:100b 1:100b 2:100b 9h 9at+ 80a+ 12a+ 150a+ 2a+ 14b
    1:100b 1:100b 7at+ 1a+ 240a+ 6a+ 30ah 60a+ 9b
    2:100b 3b 8at+ 25a:30+ 40a+ 4at+ 1a+ 1a+ 2a+ 70a+ 5at+ 90a+ 12ab 3b
    5b 4at+ 60a+ 3a:100+ 80a+ 12a:90+ 30a+ 28ab 6b
    6at+ 120a+ 12aw 95a+ 8aw 70a+ 3aw:100 50a+ 20b
    5at+ 45aw+ 38aw+ 52a+ 41aw+ 6aw:100 33a+
    1:100b 4at+ 90a+ 20ah 60ah 44ah 7b
    3at+ 35a+ 2a:100 3a:100 2a:100 1a:100 40a+ 60b
    6at+ 22a+ 2a:100 2a:100 3a:100 2a:100
    9at+ 75a+ 11a:100+ 14a:100+ 9a:100+ 25a+
    2b 9h 10t 30h 25h 1a+ 4b
    1a+
    2at+ 3a+ 1a+ 2a+ 1a+ 1a+
    7at+ 200a+ 3ab:100 10ab 45ab 5ab 60a+
    40b 35b 6at+ 50a+ 33b 90b
    4t 6 2:100 9at+ 120a+ 60 35 48 20
    60 9at+ 80a+ 70 25:50 4
    8mt+ 60m+ 15m+ 90m+ 2m:100 3m:100 2m:100 25mh 10b
    5mt+ 18m+ 35m+ 4m+ 44mw+ 40m+ 9mw 66m+ 6mh
    2:100 1:100 2:100 7t+ 60+ 35+ 8+ 120+ 5+ 80+ 3:100 2:100 6
    1:100 2:100 40+ 22:10+ 90:4+ 12+ 3:100 4:100 4
    3:100 5 2:100 6t+ 200+ 2:100 1:100 9
    10:60 2:100 2:100 55+ 14+ 25+ 18+ 60+ 5:100 4:100
    5:100 9:100 7:100 8:100 6:100 40:80 12:70 9:100
    2:100 4t+ 45+ 6t+ 30+ 7t+ 52+ 2 1:100 2:100 3
    120+ 95+ 60:5+ 35+ 8+ 70+
    200+
    22+ 9+ 40+ 28+
    30b 25h 60h 80h 2:100b 50bh
    2:100 20h 4t+ 38+ 45+ 12w 52+ 41w+ 39+ 8w 3:100
    6t+ 75+ 33w+ 80+ 10w:50 66+ 20h 4 2:100
    3 2:100 4:100 6t 2:100 3:100 5 2:100
    5at+ 40a+ 2a:100+ 55a+ 6a:100+ 30a+ 4a:80+ 18a+ 9a:100+
    7at+ 28a+ 1a:100+ 90a+ 3a:100+ 64a+ 15a:50+ 1a+
    4at+ 66a+ 3a:100 4a:100 2a:100 5a:100 3a:100 30a+ 6b:100
    5t+ 33+ 50+ 3:100+ 44+ 7+ 35+ 4+
    28+ 60+ 12+ 40+ 2+
    6t+ 90+ 70+ 1+ 55+ 9+
    4at+ 50a+ 18aw+ 21aw+ 60a+ 12aw 70a+ 17aw+ 24aw+
    5at+ 60a+ 2ab:100 2ab:100 60a+ 3ab:100 45a+
    60a+ 1ab 1ab:100 60a+ 2ab 2ab:100 1ab:100 7a+
    70a+ 2ab:100 65a+ 1ab:100 5a+ 2ab:100 1a+
    4at+ 80a+ 12ab:100 80a+ 30ab:90 90a+ 8ab:50 30a+
    3at+ 6a+ 4ab:100 5a+ 9ab:100 4a+ 20ab:60 3a+
    90a+ 5ab:100 6ab:100 4ab:100 5ab:100 3ab:100
    2ab:100 1ab:100 3at+ 40a+ 3a:100+ 45a+ 3ab:100 50a+
"""
DEPTH, LEAST = 9, 2


def labelled(table: str = LABELLED) -> list[list[tuple]]:
    """The pages of the table: per block its features and 1 for main text."""
    pages = []
    for line in table.strip().splitlines():
        blocks, want = [], []
        for n, first, links, flags, main in re.findall(r"(\d+)([a-z]*):?(\d*)([a-z]*)(\+?)", line):
            f, words = first + flags, int(n)
            blocks.append(Block("", words, words * int(links or 0) / 100, 2 * ("a" in f) or int("m" in f), int("b" in f), 2 * ("h" in f) or int("w" in f), int("t" in f)))
            want.append(int(bool(main)))
        pages.append([(*row, y) for row, y in zip(features(blocks), want)])
    return pages


def best_split(rows):
    """(impurity, feature, cut) of the split with the least Gini impurity, each side of LEAST rows at least; None if there is none."""
    ones, best = sum(r[-1] for r in rows), None
    for f in range(len(FEATURES)):
        order = sorted(rows, key=lambda r: r[f])
        seen = 0
        for i in range(1, len(order)):
            seen += order[i - 1][-1]
            if order[i][f] == order[i - 1][f] or min(i, len(order) - i) < LEAST:
                continue
            rest = ones - seen
            gini = seen * (i - seen) / i + rest * (len(order) - i - rest) / (len(order) - i)
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, (order[i][f] + order[i - 1][f]) / 2)
    return best


def grow(rows, depth=DEPTH):
    """CART: a class, or (feature, cut, below, above)."""
    ones = sum(r[-1] for r in rows)
    best = best_split(rows) if depth and 0 < ones < len(rows) else None
    if best is None:
        return int(2 * ones > len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[f] <= cut], depth - 1), grow([r for r in rows if r[f] > cut], depth - 1)


@lru_cache(1)
def tree():
    return grow([r for page in labelled() for r in page])


def features(blocks: list[Block]) -> list[tuple]:
    """Where a page has an article, its other parts are no main part."""
    page = max((b.article for b in blocks), default=0)
    shape = [(0, 0), *((b.words, 100 * b.link_words / b.words) for b in blocks), (0, 0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2], int(b.article == page > 0), b.boiler, b.hint, b.heading, int(page > 0)) for i, b in enumerate(blocks)]


def is_main(row, node=None) -> bool:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, row in zip(blocks, features(blocks)) if is_main(row))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for b in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})
        released()

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
