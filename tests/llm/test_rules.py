"""Certified quality rules against plain Python, on odd rows and made-up labels."""

import math
import random
import re

from pyspark.sql import functions as F

from blastradius.llm import rules

SCHEMA = "doc_id long, text string, lang string, stratum string, n_words string, kept string"
LABELS = "doc_id long, quality int, stratum string, text string"
ODD = [
    "", None, " \n\t", "a", "a b", "a b c", "a b c a b c", "x\n x\nx\n\n", "# * $ % & | < > é\x1c", "same line\n" * 70, "w " * 60,
    "one two three four five six seven eight nine ten eleven twelve " * 6, "日本語 " * 55, "y" * 300_000,
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measures(text):
    words, text = words_of(text), text or ""
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else set()
    lines = [x for x in text.split("\n") if words_of(x)]
    covered = {i + o for i, w in enumerate(windows) if w in twice for o in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def table():
    rnd = random.Random(4)
    out, labels = [], []
    for i in range(2600):
        lang, bad = ("en" if i % 13 else "rare"), i % 5 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(60)]
        if bad and i % 2:
            words = [w + "%%" for w in words]
        elif bad:
            words = [w * 4 for w in words]
        elif i % 601 == 1:
            words = [w + "##" for w in words]  # good, and some would be lost
        out.append((i, "\n".join(" ".join(words[j : j + 10]) for j in range(0, 60, 10)), lang, "x", "y", "z"))
        labels.append((i, 0 if bad else 1, "s", "t"))
    out += [(9000 + i, t, None if i % 2 else "en", "x", "y", "z") for i, t in enumerate(ODD)]
    out += [out[7], out[7], (None, out[8][1], "en", None, None, None), (None, None, None, None, None, None)]
    labels += [(0, 1, "", ""), (None, 1, "", ""), (3, None, "", ""), (77_777, 0, "", "")]
    return out, labels


def at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_against_plain_python(spark):
    rows, labels = table()
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)
    risk = 0.06  # the fixture is small
    got = rules.judged(docs, marks, risk=risk)
    assert got.columns == ["doc_id", *rules.MEASURES, "base_failed", "rejected_by", "kept"]
    worst: dict = {}
    for i, q, *_ in labels:
        if i is not None and q is not None:
            worst[i] = min(worst.get(i, q), q)
    held = [(i, lang or "", dict(zip(rules.MEASURES, measures(t), strict=True))) for i, t, lang, *_ in rows]
    failed = lambda m: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    beyond = lambda r, c, m: 1000 * m[r[1]] > c * m[r[3]] if r[2] == ">" else 1000 * m[r[1]] < c * m[r[3]]
    known = [(s, worst[i], m) for i, s, m in held if i in worst and not failed(m)]
    strata = {s for s, *_ in known}
    taken = {}
    for s in strata:
        good, bad = [m for x, q, m in known if x == s and q], [m for x, q, m in known if x == s and not q]
        for r in rules.RULES:
            useful = []
            for c in r[4]:
                k, b = (sum(beyond(r, c, m) for m in part) for part in (good, bad))
                if k > len(good) * risk / 5 or at_most(k, len(good), risk / 5) > rules.MISS / (5 * len(strata)):
                    break
                if b and b * len(good) >= rules.LIFT * k * len(bad):
                    useful.append((c, b))
            most = max((b for _, b in useful), default=0)
            taken[s, r[0]] = next((c for c, b in useful if 100 * b >= rules.NEARLY_ALL * most), None)
    assert taken["en", "symbols"] and taken["en", "long_words"] and taken["rare", "symbols"] is None
    want = []
    for i, s, m in held:
        broken = [r[0] for r in rules.RULES if taken.get((s, r[0])) is not None and beyond(r, taken[s, r[0]], m)]
        by = "base" if failed(m) else ",".join(broken)
        want.append(str((i, *m.values(), failed(m), by, by == "")))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)


def test_binomial(spark):
    cases = [(k, n, p) for n in (1, 9, 10, 57, 800) for k in (0, 1, 3, 8) for p in (0.004, 0.05, 0.3) if k <= n * p]
    cases += [(31, 10_000, 0.004)]
    for p in (0.004, 0.05, 0.3):
        part = [(k, n) for k, n, x in cases if x == p]
        for r in spark.createDataFrame(part, "k long, n long").withColumn("q", rules.binomial_at_most(F.col("k"), F.col("n"), p)).collect():
            assert math.isclose(r.q, at_most(r.k, r.n, p), rel_tol=1e-9), r


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "word " * 10, "en", "", "", ""), (2, " ".join(map(str, range(60))) + "#" * 90, None, "", "", "")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert {r.doc_id: r.rejected_by for r in rules.judged(docs, none).collect()} == {1: "base", 2: ""}
    assert rules.judged(docs.limit(0), none).count() == 0
