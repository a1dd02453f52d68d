"""Each operator against a brute-force version, on a small table of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from blastradius.llm import exact_dedup, fingerprint, jaccard, language, license, packing, pieces, pii, quality, warc
from blastradius.llm.common import workspace

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "a", "A b  c\n", "a b c", "A b c ", "x" * 5000, "İ, ΣΑΣ\x1cq\x00 é ﬁ 😀日本", "we'll <|endoftext|> ▁ ▁▁ <0x41> <s>",
    "mail foo@bar.example.com word", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 +1 (555) 123-4567", "x@y@z.com a@b.c_d@e.f",
    "Licensed under the Apache License, Version 2.0. All rights reserved.", "Released under the MIT License.\nReleased under the MIT License.",
]
SCHEMA = "doc_id long, text string, kept string, _row string, component long"


def rows() -> list[tuple]:
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(60)]
    texts = list(ODD)
    for _ in range(25):
        t = list(base)
        for _ in range(rnd.choice((0, 0, 1, 2, 5))):
            t[rnd.randrange(60)] = rnd.choice(words)
        texts.append(" ".join(t))
    for n in (9, 10, 11, 20):
        t = [rnd.choice(words) for _ in range(n)]
        texts += [" ".join(t), " ".join([*t, "z"]), " ".join(t[1:])]
    out = [(i * 3, t, "k", "r", 1) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, "a b c", None, None, None), (None, None, None, None, None), (12, "another text of one id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    for f in (exact_dedup.copies, exact_dedup.drop_copies, fingerprint.fingerprints, jaccard.linked, jaccard.one_of_each, pii.found, pii.sanitise, license.scan, quality.judged, quality.keep_good):
        assert f(empty).count() == 0, f.__name__
    assert language.identified(empty.withColumn("lang", empty.text)).count() == 0
    assert packing.packed_documents(empty, WORDS).count() == 0
    assert pieces.encoded(empty, PIECES).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), workspace(spark).root + "/none").count() == 0


def test_exact_copies(docs):
    normal = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups: dict = {}
    for i, t, *_ in rows():
        groups.setdefault(normal(t), []).append(i)
    want = sorted((str(i), str(min((x for x in groups[normal(t)] if x is not None), default=None)), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, *_ in rows())
    got = exact_dedup.copies(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)


def test_copies_over_many_ranges(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"t{i}") for i in range(900)], "doc_id long, text string")
    got = exact_dedup.copies(docs).filter("text_sha256 = sha2('same text', 256)").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 600)}
    assert [r.doc_id for r in got if r.kept] == [1]


def test_fingerprints(spark, docs):
    plain = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(rows())], "doc_id long, text string")
    texts = [t or "" for _, t, *_ in rows()]
    got = {r.doc_id: r for r in fingerprint.fingerprints(plain).collect()}
    marks: dict = {}
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert marks.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert fingerprint.fingerprints(docs).count() == docs.count()


def test_fingerprints_add_up(spark):
    texts = spark.createDataFrame([("a", "one\ntwo\nthree"), ("b", "three\none\ntwo"), ("c", "one\ntwo"), ("d", "three")], "k string, text string")
    lanes = {r.k: r.lanes for r in fingerprint.lanes_of(texts).collect()}
    assert lanes["a"] == lanes["b"]
    assert [(x + y) % 2**32 for x, y in zip(lanes["c"], lanes["d"], strict=True)] == lanes["a"]


def test_archives(spark):
    html = "<p>" + "long enough to be referred to " * 5
    pages = spark.createDataFrame([(1, "u\n1", html), (2, None, html), (3, "é", html), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "n", "none"), (7, "big", "é" * 300_000)], "page_id long, url string, html string")
    folder = workspace(spark).root + "/archives"
    warc.write_archives(warc.with_first(pages), folder)
    for size in (1 << 22, 97):  # ranges far smaller than a record
        got = {r.page_id: r for r in warc.read_archives(spark, folder, size, with_payload=True).collect()}
        assert len(got) == 8
        assert (got[1].record_type, got[2].record_type, got[2].refers_to, got[3].refers_to) == ("response", "revisit", 1, 1)
        assert [got[i].record_type for i in (4, 5, 6, None, 7)] == ["response"] * 5
        for r in pages.collect():
            payload = (r.html or "").encode()
            assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert bytes(got[7].payload) == ("é" * 300_000).encode()


def test_archives_hold_false_members(tmp_path):
    inner = warc._member(1, None, b"x", "0", None)
    noise = tmp_path / "a"
    noise.write_bytes(b"\x1f\x8b\x08garbage" + inner + warc.EMPTY_MEMBER + inner)
    with noise.open("rb") as file:
        assert len(list(warc.records(file, 0, 10_000))) == 2
    with noise.open("rb") as file:
        assert len(list(warc.records(file, 11, 12))) == 0


def test_languages(spark):
    rnd = random.Random(1)
    parts = {"en": "the and tion ing", "de": "der sch ung ein", "fr": "eau les ment oui", "es": "cion los ado que"}
    make = lambda k: " ".join(rnd.choice(parts[k].split()) + rnd.choice(parts[k].split()) for _ in range(30))
    docs = spark.createDataFrame([(i, make(k), k) for i in range(400) for k in [list(parts)[i % 4]]] + [(9999, "12 !?", "en"), (9998, None, "en"), (None, "the", None)], "doc_id long, text string, lang string")
    got = language.identified(docs).join(docs, "doc_id").collect()
    plain = [r for r in got if r.doc_id < 9000]
    assert np.mean([r.lang_pred == r.lang for r in plain if r.held_out]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id >= 9000} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)


def test_packing(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    for _, text, *_ in rows():
        assert packing.token_ids(packing.word_ids(WORDS), pa.array([text or ""]))[0].tolist()[:-1] == tokenizer.encode(text or "", add_special_tokens=False).ids
    got = packing.packed_documents(docs, WORDS, capacity=64).collect()
    places: dict = {}
    for r in got:
        assert 1 <= r.length <= 64
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r.piece == 0 for r in got) == docs.count()
    assert len(places) <= packing.lower_bound(np.array([r.length for r in got]), 64) + 1


def test_packing_in_rounds(spark):
    rnd = random.Random(2)
    items = spark.createDataFrame([(i, 0, 0, rnd.choice((7, 13, 33, 34, 50, 64)), 0) for i in range(2000)], packing._ITEM)
    got = packing.pack(items, 64, per_partition=150).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    fill: dict = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 64
    assert len(fill) <= 1.02 * packing.lower_bound(np.array([r.length for r in got]), 64) + 1


def test_lower_bound_never_exceeds_best():
    rnd = random.Random(3)
    for _ in range(200):
        lengths = np.array([rnd.randint(1, 20) for _ in range(rnd.randint(1, 40))])
        assert packing.lower_bound(lengths, 20) <= packing.best_fit(lengths, 20)[2].size


def brute_components() -> list[tuple]:
    table = rows()
    sets = []
    for _, t, *_ in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    group = list(range(len(table)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return [(str(r[0]), len(s), str(r[0] if not s else min((q[0] for q, h in zip(table, group, strict=True) if h == g and q[0] is not None), default=None))) for r, s, g in zip(table, sets, group, strict=True)]


def test_jaccard_join(docs, monkeypatch):
    want = sorted(brute_components())
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.linked(docs).collect()) == want
    monkeypatch.setattr(jaccard, "BLOCK", 600)  # all of the large regions' ways
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.linked(docs).collect()) == want


def test_near_copies_of_the_pipeline(spark):
    rnd = random.Random(8)
    texts = []
    for n in (4, 6, 8, 12, 30, 60, 200, 1000):
        for _ in range(3):
            base = [f"v{rnd.randrange(10**6)}" for _ in range(n)]
            texts.append(base)
            for share in (0.005, 0.01, 0.02, 0.03):
                copy = list(base)
                for i in rnd.sample(range(n), max(1, round(share * n))):
                    copy[i] = f"x{rnd.randrange(10**6)}"
                texts += [copy, base[: n - max(1, round(5 * share * n))]]
    texts = [" ".join(t) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = sorted({min(i for i, h in enumerate(group) if h == g) for g in group})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want


def test_linked_sets_have_a_part_in_common():
    rnd = random.Random(9)
    for share in ((90, 100), (80, 100), (50, 100)):
        for n in [*range(1, 60), 300, 2000]:
            a = [rnd.getrandbits(63) for _ in range(n)]
            for m in range(n * share[0] // share[1], n + 1):
                if n > 60 and m % 40 or m == 0:
                    continue
                # As many replaced as the share allows.
                swaps = max(k for k in range(m + 1) if share[1] * (m - k) >= share[0] * (n + k)) if share[1] * m >= share[0] * n else None
                if swaps is None:
                    continue
                b = a[: m - swaps] + [rnd.getrandbits(63) for _ in range(swaps)]
                parts = [jaccard.part_keys(np.array(sorted(x), np.uint64), share) for x in (a, b)]
                keys = [set(p.tolist()) for p, _ in parts]
                assert keys[0] & keys[1], (share, n, m, swaps)
                # Whichever parts are the most crowded, one that both keep is left.
                for order in (1, 2, 3):
                    kept = []
                    for p, spare in parts:
                        held = [(zlib.crc32(b"%d:%d" % (order, k)), k, x) for k, x in zip(p.tolist(), spare.tolist(), strict=True)]
                        kept.append({k for x in set(spare.tolist()) for _, k, _ in sorted((h for h in held if h[2] == x), reverse=True)[x // jaccard.SPARE :]})
                    assert kept[0] & kept[1], (share, n, m, swaps)


def test_regions_lose_no_link():
    rnd = random.Random(4)
    base = set(range(200))
    sets = [np.array(sorted((base - set(rnd.sample(range(200), k))) | {1000 * i + x for x in range(k)}), np.uint64) for i, k in enumerate(rnd.choices(range(25), k=300), 1)]
    region = jaccard._Region(sets, list(range(300)))
    region.join(np.arange(300))
    plain = [set(s.tolist()) for s in sets]
    group = list(range(300))
    for i in range(300):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= 90 * len(plain[i] | plain[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    assert len({*group}) == len({*region.of.tolist()})
    assert len({*zip(group, region.of.tolist(), strict=True)}) == len({*group})


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind: str, m: str) -> bool:
    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data(docs):
    want: dict = {}
    for i, t, *_ in rows():
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t or "") if valid(k, m.group()))
        want.setdefault(i, []).append(hashlib.sha256(spans.encode()).hexdigest())
    got: dict = {}
    for r in pii.found(docs).collect():
        got.setdefault(r.doc_id, []).append(r.base_sha256)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_words_that_give_away(spark):
    texts = ["ask zanzibar about jo@x.example now", "see zanzibar or jo@x.example now", "now about this", "now see that", "about those now", None]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    assert spans == {0: "email:19:31,drop:4:12", 1: "email:16:28,drop:4:12", 2: "", 3: "", 4: "", 5: ""}
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert (clean[0].text, clean[0].n_chars, clean[2].text, clean[5].text) == ("ask  about <EMAIL> now", 22, "now about this", None)


def test_licences(docs):
    got = {r.doc_id: (r.licences, r.n_sentences) for r in license.scan(docs).filter("n_sentences > 0").collect()}
    assert got == {14 * 3: ("Apache-2.0,LicenseRef-proprietary", 2), 15 * 3: ("MIT", 2)}
    ids = "".join(f"|{x}|" for x in ("MitGrant", "MitKeep", "AsIs", "MitKeep"))
    row = docs.limit(1).selectExpr(f"'{ids}' as s")
    assert tuple(row.select(*license.matched(row.s)).first()) == ("MIT", "|MitKeep|")


def test_words_anywhere_in_a_document_give_away(spark):
    gap = "word " * 40
    texts = [f"Lee said {gap}jo@x.example and Zanzibar, {gap}zanzibar leeway", f"jo@x.example {gap}zanzibar and lee said", *["and said word leeway"] * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean == {0: f" said {gap}<EMAIL> and , {gap} leeway", 1: f"<EMAIL> {gap} and  said", **dict.fromkeys(range(2, 8), texts[2])}
    want = [("drop", m.start(), m.end()) for m in re.finditer(r"\b(Lee|[Zz]anzibar)\b", texts[0])]
    spans = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    assert spans[0].split(",")[1:] == [":".join(map(str, x)) for x in want]


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

(2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

* Neither the name of Some Company, Inc. nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_licences_in_wrapped_lines(spark):
    texts = [(t, licence, n) for t, licence, n in ((MIT, "MIT", 5), (APACHE, "Apache-2.0", 5), (BSD, "BSD-3-Clause", 7), (GPL, "GPL-3.0-or-later", 3))]
    want, given = {}, []
    for t, licence, n in texts:
        for lead, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n"), ("dnl ", "\n")):
            want[len(given)] = (licence, "", n)
            given.append((len(given), "".join(lead + line + end for line in t.splitlines())))
    for t, licence in (("// SPDX-License-Identifier: MIT\nimport os", "MIT"), (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later"), ("not released under the MIT License at all", "")):
        want[len(given)] = (licence, "", {"MIT": 1, "": 0}.get(licence, 3))
        given.append((len(given), t))
    got = {r.doc_id: (r.licences, r.unmatched_ids, r.n_sentences) for r in license.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert got == want


def test_quality(spark):
    rnd = random.Random(6)
    words = [a + b for a in "ba de fi go lu ma ne po ri su".split() for b in "ta len mor nis ker dul".split()]
    good = lambda: " ".join(f"The {rnd.choice(words)} of {rnd.choice(words)} and {rnd.choice(words)}." for _ in range(12))
    bad = lambda: rnd.choice((" | ".join(rnd.choices(words, k=40)), "### ".join(rnd.choices(words, k=40)), " ".join([rnd.choice(words)] * 40)))
    docs = spark.createDataFrame([(i, bad() if i % 6 == 0 else good(), 1) for i in range(600)] + [(-1, None, 1), (-2, "", 1)], "doc_id long, text string, quality_score long")
    got = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert not got[-1] and not got[-2]
    assert np.mean([got[i] == (i % 6 > 0) for i in range(600)]) > 0.97
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_pieces(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in pieces.encoded(docs, PIECES, keep_ids=True).join(docs, "doc_id").collect():
        if r.doc_id == 12:  # two texts of one id
            continue
        ids = model.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == model.decode(ids) and r.n_tokens == len(ids)
    assert pieces.piece_table(PIECES).decode([1, 3 + 0xC3, 40, 2]) == model.decode([1, 3 + 0xC3, 40, 2])


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = workspace(spark).save(out, "stage")
    packed = corpus_pipeline.run(spark, sf).select("doc_id").distinct()
    assert packed.count() == docs.count() > 0


def test_repeated_rows_hide_no_word(spark):
    told = [(i, t) for i, t in enumerate(["zanzibar writes jo@x.example", "ask zanzibar at jo@x.example", "plain words only", "other words here", "more plain words"])]
    spans = [{r.doc_id: r.spans for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()} for rows in (told, told + told[:1] * 3 + told[2:3] * 2)]
    assert spans[0] == spans[1] and "drop:0:8" in spans[0][0] and "drop:4:12" in spans[0][1]


def added_spans(rows: list) -> dict:
    """Spans of telling words by (doc_id, text), in plain Python."""
    docs = {(i, t or "") for i, t in rows}
    base = {d: [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, d[1]) if valid(k, m.group())] for d in docs}
    everywhere = {d: {w.lower() for w in regex.findall(r"\p{L}+", d[1])} for d in docs}
    beside = {}
    for d, spans in base.items():
        chars = list(d[1])
        for _, start, end, _ in spans:
            chars[start:end] = " " * (end - start)
        beside[d] = {w.lower() for w in regex.findall(r"\p{L}+", "".join(chars))} if spans else set()
    values = {d: {f"{k}:{v.lower()}" for k, _, _, v in spans} for d, spans in base.items()}
    n, n_word = len(docs), Counter(w for words in everywhere.values() for w in words)
    n_value = Counter(v for held in values.values() for v in held)
    n_pair = Counter((v, w) for d in docs for v in values[d] for w in beside[d])
    kinds = {}
    for (v, w), pairs in n_pair.items():
        if pairs > 1 and 1 < n_value[v] < n:
            told = math.log(n * pairs / (n_value[v] * n_word[w])) / math.log(n / n_value[v])
            if told >= pii.GENERALISE:
                kinds[v, w] = "drop" if told >= pii.REMOVE else "term"
    out = {}
    for d in docs:
        marks = {}
        for (v, w), kind in kinds.items():
            if v in values[d] and w in beside[d]:
                marks[w] = min(kind, marks.get(w, kind))
        places = [(marks[m.group().lower()], m.start(), m.end()) for m in regex.finditer(r"\p{L}+", d[1]) if m.group().lower() in marks]
        out[d] = sorted(x for x in places if not any(x[1] < e and s < x[2] for _, s, e, _ in base[d]))
    return out


def test_added_spans_against_brute_force(spark):
    draw = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    values = ["jo@x.example", "Ann.Lee@corp.example", "10.1.2.3", "+1 202 555 0143"]
    rows: list = [(900, None), (901, ""), (902, "jo@x.example")]
    for i in range(240):
        text = draw.choices(words, k=draw.choice([3, 12, 60]))
        for j, value in enumerate(values):
            if draw.random() < 0.1:
                text += [value, *[f"{draw.choice('zZ')}an{'äbc日'[j]}"] * draw.choice([1, 4])]
            elif j % 2 and draw.random() < 0.015:  # seen without its value too
                text.append(f"zan{'äbc日'[j]}")
        draw.shuffle(text)
        rows.append((i, " ".join(text).upper() if draw.random() < 0.1 else " ".join(text)))
    rows.append((950, " ".join(["jo@x.example", *(["zanä", "wak"] * 20_000)])))  # a text of many marks takes time in proportion to it
    rows += rows[5:9] * 3
    want = added_spans(rows)
    kinds = Counter(k for spans in want.values() for k, *_ in spans)
    assert kinds["drop"] > 0 and kinds["term"] > 0 and sum(kinds.values()) > 20_000, kinds
    for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got = [s.split(":") for s in r.spans.split(",") if s.split(":")[0] in ("drop", "term")]
        texts = [t for i, t in rows if i == r.doc_id]
        assert [(k, int(a), int(b)) for k, a, b in got] == want[r.doc_id, texts[0] or ""], r.doc_id


def test_names_of_columns_may_clash(spark, docs):
    odd = docs.withColumnRenamed("kept", "_quality_score").withColumnRenamed("component", "_stays")
    for f in (quality.keep_good, jaccard.one_of_each):
        got = f(odd)
        assert got.columns == odd.columns and got.count() > 0
