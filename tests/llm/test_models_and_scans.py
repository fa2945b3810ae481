"""Fitted operators, scans, archives and searches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltrace.llm import decontaminate, language_id, license_scan, pii, quality, queries, textkernel, topk, warc

# --- language


def test_language(spark, prose):
    en, de = "the and river stone light paper that with".split(), "der und fluss stein licht papier nicht über".split()
    rows = [(k, prose(30, k, de if k % 2 else en), "de" if k % 2 else "en") for k in range(60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "de"), (903, prose(20, 5, de), None), (904, "über und", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    held = language_id.remainder("doc_id", 5) == 0
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs, ~held)).collect()}
    assert all(got[k].lang_pred == ("de" if k % 2 else "en") and 0.5 < got[k].score <= 1 for k in range(60))
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and got[902].score == 0.0
    empty = docs.where("false")
    nothing = language_id.fit(empty, F.lit(True))
    assert nothing.languages == [] and {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, nothing).count() == 0


def test_bucket_offsets_do_not_depend_on_neighbours():
    texts = ["abc", "x y", "", None, "..", "é1b", "a."]
    flat, first, _ = language_id.buckets(texts)
    for k, t in enumerate(texts):
        alone, bounds, _ = language_id.buckets([t])
        # behind another text a boundary may follow that a last text doesn't have
        own = flat[first[k] : first[k + 1]]
        assert np.array_equal(own[: bounds[-1]], alone[: len(own)])


# --- quality


def test_quality(spark, prose):
    rng = random.Random(2)
    good = [prose(rng.randrange(20, 80), k) + "." for k in range(200)]
    bad = [" ".join(w.upper() + "!!" for w in prose(30, k).split()) if k % 2 else "spam " * 40 for k in range(200)]
    rows = list(enumerate([x for p in zip(good, bad, strict=True) for x in p])) + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.7) == (k % 2 == 0) for k in range(300, 400)]) > 0.95
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5} and quality.score(docs.where("false"), none).count() == 0


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_model(x, y)
    assert {frozenset(p) for p in model.pairs[:1]} == {frozenset((0, 1))} and np.mean((model.score(x) > 0.5) == y) > 0.95


# --- search


def brute_top(rows, k, every):
    ints = {}
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            ints[i] = [int(np.floor(256 * float(np.float32(c)))) for c in v]
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [16, 10_000])
def test_top_k_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=12) * (1 + k % 7)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(k, rows[3][1]) for k in range(200, 260)]  # one vector very often
    rows += [(300, None), (350, [1.0, None] + [0.0] * 10), (400, [float("nan")] + [0.0] * 11), (450, [float("inf")] + [0.0] * 11), (500, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("id") % 50 == 0, 5, block=block, query_block=4)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 5, 50)
    assert topk.top_k(df.where("false"), F.col("id") % 50 == 0).count() == 0
    assert [(r.query_id, r.vec_id) for r in topk.top_k(df.where("vec_id IN (50, 3)"), F.col("id") % 50 == 0).collect()] == [(50, 3)]


# --- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))


def test_archives_round_trip_and_audit(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>é {k}</p>\r\n\r\n" * (k % 4)) for k in range(60)] + [(2000, None, "z"), (2001, "u", None), (None, "n", "null id"), (7, "http://x/7", "copy"), (7, "http://x/7", "copy")]
    records = warc.to_records(pages(spark, rows), span=16)
    places = warc.layout(records)
    files = warc.archives(records).select(F.concat_ws("-", "archive", "part").alias("path"), "content")
    want = sorted((u or "", h or "") for _, u, h in rows)
    parsed = warc.read_archives(files)
    assert sorted((r.url or "", r.html) for r in parsed.collect()) == want
    known = {(r.path, r.offset) for r in parsed.collect()}
    assert {(f"{r.archive}-{r.part}", r.offset) for r in places.collect()} == known
    warc.write_archives(records, str(tmp_path / "w"))
    assert sorted((r.url or "", r.html) for r in warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "w"))).collect()) == want
    assert {r.status for r in warc.audit(places, places).collect()} == {"ok"}
    other = [(i, u, "changed" if i == 3 else h) for i, u, h in rows if i != 20] + [(59, "more", "extra")]
    got = {(r.page_id, r.seq): r.status for r in warc.audit(places, warc.layout(warc.to_records(pages(spark, other), span=16))).collect()}
    status = {}
    for (i, _), s in got.items():
        status.setdefault(i, set()).add(s)
    assert status[3] == {"corrupt"} and status[20] == {"missing"} and status[21] == {"moved"} and status[40] == {"ok"} and status[1] == {"ok"} and "extra" in set().union(*status.values())
    empty = warc.layout(warc.to_records(pages(spark, rows).where("false")))
    assert warc.audit(empty, empty).count() == 0 and {r.status for r in warc.audit(places, empty).collect()} == {"missing"}


def test_root_changes_with_any_record(spark):
    a = warc.layout(warc.to_records(pages(spark, [(k, "u", "x") for k in range(40)])))
    b = warc.layout(warc.to_records(pages(spark, [(k, "u", "y" if k == 33 else "x") for k in range(40)])))
    trees = [warc.tree(t) for t in (a, b)]
    roots = [t[-1].first().hash for t in trees]
    assert roots[0] != roots[1] and [r.idx for r in warc.differing_leaves(*trees).collect()] == [33]


# --- contamination


@pytest.mark.parametrize("tokens", [decontaminate.BLOCK_TOKENS, 8])
def test_contamination(spark, docs, prose, monkeypatch, tokens):
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", tokens)
    item, short = prose(30, 1), "tiny item here"
    words = item.split()
    some = [w if k % 9 else "other" for k, w in enumerate(words)]
    rows = [(1, f"{prose(50, 2)} {item} {prose(9, 3)}"), (2, " ".join(w.upper() + "!!" for w in words)), (3, prose(60, 4)), (4, " ".join(some)), (5, " ".join(words[:7])), (6, None), (7, ""), (8, f"a {short} b"), (9, "tiny item"), (10, item), (10, item), (11, " ".join(words[10:]))]
    bench = spark.createDataFrame([(70, item), (71, short), (72, None), (73, ""), (74, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs(rows), bench)
    found = sorted({(r.doc_id, r.item_id) for r in got.collect()})
    assert found == sorted([(d, i) for d in (1, 2, 4, 10, 11) for i in (70, 74)] + [(8, 71)])
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs(rows), bench).collect()) == [3, 5, 6, 7, 9]
    assert got.where("doc_id = 1 AND item_id = 70").first().first_token == 50
    assert decontaminate.contaminated(docs([]), bench).count() == 0 and decontaminate.contaminated(docs(rows), bench.where("false")).count() == 0


def naive_overlap(item, text):
    """All shifts of an item against a text, without seeds."""
    a, b = (textkernel.tokens_of(*textkernel.text_bytes(pa.array([t])))[0] for t in (item, text))
    for s in range(1 - len(a), len(b)):
        lo, hi = max(s, 0), min(s + len(a), len(b))
        x, y = decontaminate.best_stretch(b[lo:hi] == a[lo - s : hi - s])
        if y - x >= min(len(a), decontaminate.SHORTEST) and (y - x >= decontaminate.COVER * len(a) or y - x >= decontaminate.LEAST):
            return True
    return False


@pytest.mark.parametrize("n", [1, 3, 5, 6, 8, 12, 13, 14, 20, 40])
def test_seeds_lose_no_overlap_of_a_naive_aligner(n):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(2000)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=20) + [rng.choice(vocabulary) if rng.random() < (0.1, 0.15, 0.2)[k % 3] else w for w in item] + rng.choices(vocabulary, k=20)) for k, item in enumerate(items)]
    table = decontaminate.build_table(list(range(60)), [" ".join(i) for i in items])
    got = {(d, i) for d, i, *_ in decontaminate.match(table, *textkernel.tokens_of(*textkernel.text_bytes(pa.array(texts)))) if d == i}
    want = {(k, k) for k in range(60) if naive_overlap(" ".join(items[k]), texts[k])}
    assert len(want) > 10 and got <= want and len(got) >= 0.98 * len(want)


def test_tokens_of_any_script():
    def tokens(*texts):
        h, first = textkernel.tokens_of(*textkernel.text_bytes(pa.array(texts)))
        return [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]

    plain, quoted, dashed, other = tokens("The old house", "“the OLD house”", "the—old—house…", "the old houses")
    assert plain == quoted == dashed != other
    a, b = tokens("ÉTÉ Straße ЗИМА Ωmega", "été straße, зима ωMEGA")
    assert a == b and len(a) == 4
    a, b = tokens("我们在这里见面。", "x我们在这里见面y")
    assert len(a) == 7 and b[1:8] == a and len(b) == 9
    assert tokens("a", "é", "", "b c") == [tokens("a")[0], tokens("é")[0], [], tokens("b c")[0]]


def test_contamination_in_other_scripts(spark, docs):
    item = "为什么天空是蓝色的而日落时却变成红色请说明原因"
    rows = [(1, f"前面有一些文字{item}后面也有一些"), (2, "前面有一些文字后面也有一些"), (3, "“Why”—is the sky «blue» at noon—and red at dusk?")]
    bench = spark.createDataFrame([(7, item), (8, "why is the sky blue at noon and red at dusk")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), bench).collect()) == [(1, 7), (3, 8)]


def test_best_stretch():
    assert decontaminate.best_stretch(np.array([1, 1, 1, 0, 1, 1], bool)) == (0, 6)
    assert decontaminate.best_stretch(np.array([0, 0, 0], bool)) == (0, 0)
    a, b = decontaminate.best_stretch(np.array([0] * 9 + [1] * 8 + [0] * 9, bool))
    assert (a, b) == (9, 17)


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(v if n % 2 == 0 else sum(divmod(2 * v, 10)) for n, v in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_against_plain_patterns(spark, docs):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab.@-_%+ 1279()\né😀") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["a@b.c_d@e.f x@foo@bar.com é😀 a@b.co", "1.2.3.4.5 300.1.1.1 0000255.1.1.1 1.1.1.1", "4929 3483 8514 6306 9 4929-3483-8514-6306 +1 (017) 555-7713", "9" * 30000 + " " + "a" * 30000 + " a@b", "+1" + "(" * 3000, None, ""]
    df = docs(list(enumerate(texts)))
    got = pii.find(df, pii.fit(df)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert [(s.start, s.kind, s.end) for s in r.base] == base_of(t or ""), t
        assert {(s.start, pii.KINDS[s.kind], s.end) for s in r.base} <= {(s.start, s.kind, s.end) for s in r.spans}
    assert pii.find(df.where("false"), pii.fit(df.where("false"))).count() == 0


def test_addresses_with_zero_parts(docs):
    rng = random.Random(11)
    texts = ["10.0.0.1", "0.0.0.0", "x 127.0.0.1 y 192.168.0.1", "1.2.3.0 000.00.0.0 0256.0.0.1 100.0.0.255", "0.0.0", "1.0.0.256 00300.0.0.0", "0" * 4000 + ".0.0.1"]
    texts += ["".join(rng.choice("0001259.. +") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = docs(list(enumerate(texts)))
    model = pii.fit(df)
    for r, t in zip(pii.find(df, model).orderBy("doc_id").collect(), texts, strict=True):
        assert [(s.start, s.kind, s.end) for s in r.base] == base_of(t), t
    masked = [r.text for r in pii.redact(df, model).orderBy("doc_id").limit(5).collect()]
    assert masked == ["[IP]", "[IP]", "x [IP] y [IP]", "[IP] [IP] 0256.0.0.1 [IP]", "0.0.0"]


def test_added_spans_and_masking(docs):
    text = "Call phone (212) 555-0199 now. SSN 078-05-1120, mail joe [at] site [dot] com or a@b.co; version 123-45-6789"
    df = docs([(1, text), (2, None), (3, "clean text of 1998-2001")])
    model = pii.fit(df)
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(df, model).collect()}
    assert kinds == {1: ["local_phone", "national_id", "hidden_email", "email"], 2: [], 3: []}
    masked = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert masked[1] == "Call phone [LOCAL_PHONE] now. SSN [NATIONAL_ID], mail [HIDDEN_EMAIL] or [EMAIL]; version 123-45-6789" and masked[2] is None and masked[3] == "clean text of 1998-2001"


def added_of(text, model):
    """Added spans by plain Python: candidates apart from base findings, votes, likelihood."""
    base, out = base_of(text), []
    for k, kind in enumerate(pii.EXTRA_KINDS):
        for m in re.finditer(pii._CANDIDATES[kind], text):
            if any(s < m.end() and m.start() < e for s, _, e in base):
                continue
            near = text[max(0, m.start() - 32) : m.start()].lower()
            vote = lambda x, pro, contra: -1 if contra and re.search(contra, x) else int(bool(re.search(pro, x)))
            votes = (vote(m.group(), pii._FOR[kind], pii._AGAINST.get(kind)), vote(m.group(), pii._LISTS[kind], None), vote(near, pii._NEAR[kind], pii._AWAY))
            z = model.bias + model.kinds[k] + sum(w * v for w, v in zip(model.votes, votes, strict=True))
            if 1 / (1 + np.exp(-z)) >= pii.ACCEPT:
                out.append((m.start(), kind, m.end()))
    return out


def test_added_spans_against_plain_python(docs):
    rng = random.Random(21)
    parts = ["call (212) 555-0199", "tel 415-555-0100 ", "078-05-1120", "ssn 219-09-9999", "000-12-3456", "iban DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "joe [at] site [dot] com", "mail x(at)y.org", "Dr. Anna Schmidt", "Herr The", "a@b.co", "10.0.0.1", "order 555-123-4567", "+1 212 555 0199 77", "é😀 words between", "\n", "dear Mr. John Smith,"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(150)]
    df = docs(list(enumerate(texts)))
    model = pii.fit(df)
    for r, t in zip(pii.find(df, model).orderBy("doc_id").collect(), texts, strict=True):
        names = {*pii.EXTRA_KINDS}
        assert sorted((s.start, s.kind, s.end) for s in r.spans if s.kind in names) == sorted(added_of(t, model)), t


def test_very_many_findings_in_a_text(docs):
    text = " ".join(f"10.{k % 256}.0.{k // 256} (212) 555-{k % 10000:04d}" for k in range(16_000))
    df = docs([(1, text)])
    model = pii.fit_counts([])
    got = pii.find(df, model).select("base", F.expr("filter(spans, s -> s.kind = 'local_phone')").alias("more")).first()
    assert [(s.start, s.kind, s.end) for s in got.base] == base_of(text) and len(got.base) == 16_000
    masked = pii.redact(df, model).first().text
    want = re.sub(r"10\.[0-9]+\.0\.[0-9]+", "[IP]", text)
    assert (masked == re.sub(r"\(212\) 555-[0-9]{4}", "[LOCAL_PHONE]", want)) if got.more else (masked == want)


def test_expectation_maximisation_finds_the_bad_labeler():
    patterns = [(0, (1, 1, 1), 500), (0, (1, -1, 1), 300), (0, (-1, 1, -1), 300), (0, (-1, -1, -1), 500)]
    got = pii.fit_counts(patterns).reliability
    assert got["gazetteer"] < got["regex"] and got["gazetteer"] < got["context"]


# --- licences


def test_licenses(docs, prose):
    mit = license_scan.TEMPLATES["MIT"][3]
    wrapped = "\n".join(mit[k : k + 60] for k in range(0, len(mit), 60))
    rows = [
        (1, f"{prose(30, 1)}\nReleased under the MIT License.\n{prose(9, 2)}"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, prose(50, 3)), (4, None), (5, ""),
        (6, f"Copyright 2020 Someone\n{mit}"), (7, "This work is licensed under the GNU General Public License, version 2."), (8, "all the rights were well reserved by law"), (9, prose(5000, 4) + " Licensed under CC BY-NC 4.0. " + prose(3000, 5)),
        (10, "RELEASED!! UNDER!! THE!! MIT!! LICENSE."), (11, "a license to drive"), (12, wrapped), (None, "All rights reserved."),
    ]
    got = sorted(((r.doc_id, r.license) for r in license_scan.scan_licenses(docs(rows)).collect()), key=str)
    assert got == sorted([(1, "MIT"), (2, "GPL-3.0"), (6, "MIT"), (7, "GPL-2.0"), (9, "CC-BY-NC-4.0"), (10, "MIT"), (12, "MIT"), (None, "Proprietary")], key=str)
    assert license_scan.scan_licenses(docs([])).count() == 0


def test_differences_are_listed():
    s = license_scan.Scanner()
    block = license_scan.TEMPLATES["MIT"][3].replace("free of charge", "at no cost")
    saved, k = s.rank(block)[0]
    share, missing = s.confirm(block, k)
    assert s.rows[k][0] == "MIT" and saved > 0.5 and 0.9 < share < 1 and missing == ["free of charge>at no cost"]


def test_wrapped_notices_anywhere(docs, prose):
    long_lines = "\n".join(prose(900, k) for k in range(4))
    mit = license_scan.TEMPLATES["MIT"][3].split()
    eight = "\n".join(" ".join(mit[k : k + 13]) for k in range(0, len(mit), 13))
    two = "This work is licensed under the GNU General\nPublic License, version 3."
    rows = [
        (1, f"{long_lines}\n{two}\n{long_lines}"), (2, "\n".join([*(prose(5, k) for k in range(57)), eight, *(prose(5, k) for k in range(70))])),
        (3, f"{prose(20, 1)}\n\n{two}"), (4, two), (5, f"{prose(9, 2)}\n# All rights\n# reserved."), (6, f"{long_lines}\n\na license\nto drive"),
    ]
    got = sorted((r.doc_id, r.license) for r in license_scan.scan_licenses(docs(rows)).collect())
    assert got == [(1, "GPL-3.0"), (2, "MIT"), (3, "GPL-3.0"), (4, "GPL-3.0"), (5, "Proprietary")]


def test_short_notices_amid_other_templates_words():
    s = license_scan.Scanner()
    # ordinary and licence-like words, each in pieces too short to be a notice
    pieces = [" ".join(t.split()[k : k + 5]) for _, _, t, w in s.rows if len(w) > 40 for k in range(0, len(t.split()), 9)]
    short = [(name, t) for name, _, t, w in s.rows if len(w) < 16]
    for k, (name, notice) in enumerate(short):
        rng = random.Random(k)
        amid = rng.sample(pieces, 28)
        text = f"{' '.join(amid[:14])} {notice} {' '.join(amid[14:])}"
        assert name in {hit[1] for hit in s.scan(text)}, (name, notice)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the MIT License. All rights reserved.", ["MIT", "Proprietary"]),
        ("Licensed under CC BY 4.0. See the site. SPDX-License-Identifier: MIT", ["CC-BY-4.0", "MIT"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("This work is licensed under the GNU General Public License, version 2 or version 3.", ["GPL-2.0", "GPL-3.0"]),
        # one licence, whose wording holds that of another or is near it
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2. There are 3 files.", ["GPL-2.0"]),
    ],
)
def test_several_licenses_in_a_block(text, names):
    s = license_scan.Scanner()
    assert sorted(hit[1] for hit in s.scan(text)) == names
    assert sorted(hit[1] for hit in s.scan(f"{'word ' * 300}{text}{' word' * 300}")) == names


def all_windows(scanner, text):
    """Names that any template finds in any line or paragraph window, without cues, word counts or compression."""
    found = set()
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)] + [m.span() for m in license_scan._PARAGRAPH.finditer(text)]
    for a, b in spans:
        for x, y in license_scan.windows(text, a, b):
            have = license_scan.words(text[x:y])
            for k, (name, _, _, want) in enumerate(scanner.rows):
                share, missing, at = scanner.align(have, k)
                if share == 1.0 and len(at) == at[-1] + 1 - at[0] == len(want):
                    found.add(name)
    return found


def test_scan_against_all_windows_and_templates(prose):
    rng = random.Random(31)
    scanner = license_scan.Scanner()
    notices = [(name, t) for name, _, t, _ in scanner.rows if len(t) < 90]
    assert len({name for name, *_ in scanner.rows}) >= 45
    for seed in range(60):
        parts = []
        for k in range(rng.randrange(4)):
            name, t = rng.choice(notices)
            t = t.replace(" ", "\n# ") if k == 1 else t
            parts.append(f"{prose(rng.randrange(30), seed + k)}\n\n{t}\n\n{prose(rng.randrange(200), seed)}")
        text = "\n\n".join(parts)
        got = {name for _, name, *_ in scanner.scan(text)}
        # a notice that is part of a longer one goes with it
        assert all(any(n == g or n in g or g in n or n.split("-")[0] == g.split("-")[0] for g in got) for n in all_windows(scanner, text)), (text, got)
        assert got <= all_windows(scanner, " ".join(text.replace("# ", "").split("\n"))) | all_windows(scanner, text)


@pytest.mark.parametrize("ident", ["LGPL-2.1", "BSD-2-Clause", "EPL-2.0", "MIT-0", "OFL-1.1"])
def test_names_of_the_list(ident):
    scanner = license_scan.Scanner()
    for t in license_scan.short_notices()[ident]:
        assert [n for _, n, *_ in scanner.scan(f"some words\n{t}\nmore words")] == [ident], t
    assert scanner.scan("Licensed under the Nowhere Public License 2.0.") == []


# --- held-out accuracy on the synthetic tables


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op2_quality(spark, folder).where("held_out").join(labels, "doc_id").where("quality IS NOT NULL")
    assert got.count() > 50 and got.where("predicted = quality").count() / got.count() > 0.97
    got = queries.op4_language_id(spark, folder).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    assert got.count() > 100 and got.where("lang_pred = lang").count() / got.count() > 0.97
