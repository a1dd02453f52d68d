"""Divergence of sources against brute force with whole numbers, on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from blastradius.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def rows() -> list[tuple]:
    rnd = random.Random(2)
    vocabulary = {lang: [f"{lang}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] for lang in ("en", "fr")}
    out = []
    for i in range(240):
        lang, source = rnd.choice(("en", "en", "fr")), f"s{rnd.choice((0, 0, 0, 1, 2, 3, 4, 5, 6))}"
        words = [rnd.choice(vocabulary[lang][: rnd.choice((5, 20, 60))]) for _ in range(rnd.randrange(1, 30))]
        out.append((i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words), lang, source, 1, "x"))
    odd = ["", None, "1 2 3", "É é İ straße naïve", "a_b-c\x7fd\x00e", "a" * 200_000, "A B a b"]
    out += [(500 + i, t, "en", "odd", 1, "x") for i, t in enumerate(odd)]
    out += [(600, "alone", "only", "one", 1, "x"), (601, "two", None, None, 1, "x"), (602, None, None, "b", 1, "x"), (603, None, "en", "silent", 1, "x")]
    out += [(None, "É naïve é", "en", None, None, None)] * 12
    return [*out, out[3], out[3]]


def brute(table: list[tuple], top: int) -> set[tuple]:
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source, *_ in table]
    out = set()
    for lang in {d[0] for d in docs}:
        in_docs = Counter(w for x, _, ws in docs if x == lang for w in set(ws))
        kept = {w for w, n in in_docs.items() if n >= 10}
        count: dict = {}
        for x, source, ws in docs:
            if x == lang:
                count.setdefault(source, Counter()).update(w for w in ws if w in kept)
        everywhere = sum(count.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for source, c in count.items():
            pairs = [(-sum(apart(share(c, w), share(o, w)) for w in kept), other.encode()) for other, o in count.items() if other != source]
            terms = [(-apart(share(c, w), share(everywhere, w)), w.encode()) for w in kept if c[w] > 0 and share(c, w) > share(everywhere, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("width,tile", [(4096, 64), (8, 2)])
def test_against_brute_force(spark, width, tile):
    table = rows()
    got = divergence.audit(spark.createDataFrame(table, SCHEMA).repartition(3), width=width, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == brute(table, 10) and len(set(found)) == len(found)


def test_empty_quadrants_are_never_walked():
    shares = np.zeros((8, 16), np.int64)
    shares[1, 3], shares[1, 4], shares[6, 4] = 5, 6, 7
    tree = divergence.Quadtree(shares)
    found = {(int(a), int(b), int(c)) for top in range(tree.levels[-1].shape[1]) for a, b, c in zip(*tree.pairs(top), strict=True)}
    want = {(a, b, c) for c in range(16) for b in range(8) for a in range(b) if shares[a, c] or shares[b, c]}
    assert found == want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
