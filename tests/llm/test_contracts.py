"""Each opN query against brute force over small documents tables written for it."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from sparkloom.llm import langid, license_scan, line_dedup, queries, quality, simhash, token_counts, vafile, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "   ", "\n\n", "A", "straße ÀÉ", "x " * 30_000, "the same line\n" * 3, "日本語 テキスト", "\t\x0b tab \r\nx", "<s> </s> <unk> <0x0A>", "a" * 5000]


def corpus(extra=()):
    rng = random.Random(5)
    words = ["the", "a", "river", "stone", "walks", "Über", "niño", "été", "and", "of", "light", "deep"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = [b + " tail" for b in base[:20]]
    lines = ["A common line of text\n" + b for b in base[20:40]]
    return [*ODD, *base, *base[:10], *near, *lines, *extra]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts = corpus()
    n = len(texts)
    ids = list(range(n))
    # extra columns whose names clash with the operators' own
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None if i % 11 == 0 else ["en", "de"][i % 2] for i in ids]), "source": pa.array([None if i % 13 == 0 else f"s{i % 3}" for i in ids]), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "id": pa.array(ids, pa.int64()), "h": pa.array(ids), "v": pa.array(ids), "fp": pa.array(ids), "version": pa.array(ids)}), d / "documents.parquet")
    rng = np.random.default_rng(3)
    vec = [list(map(float, v)) for v in rng.normal(size=(90, 6)).astype("f4")]
    vec += [vec[0]] * 40 + [None, [1.0, None, 0, 0, 0, 0], [math.nan] * 6, [math.inf] * 6, [], [1.0, 2.0]]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vec)), pa.int64()), "embedding": pa.array(vec, pa.list_(pa.float32())), "label": pa.array([0] * len(vec))}), d / "embeddings.parquet")
    html = [None, "", "<p>é</p>", "<p>same</p>", "<p>same</p>", "x" * 100_000, "<p>same</p>", "\r\n\r\nWARC/1.1\r\n"]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array(["http://a.b.c/x?y#z", None, "http://[bad", "https://www.q.org", "http://q.org/é \r\n", "http://a.b.c/x?y", "ftp://x:y@z/", "no url"]), "html": pa.array(html)}), d / "pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([int(i % 5 > 0) for i in ids]), "toxic": pa.array([int(i % 7 == 0) for i in ids])}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1, 2, 3], pa.int64()), "text": pa.array([texts[20], None, "too short", texts[30]])}), d / "benchmark.parquet")
    return str(d), texts


@pytest.fixture(scope="module")
def empty(tmp_path_factory, sf):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{sf[0]}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_line_dedup(spark, sf):
    path, texts = sf
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOW) for x in (t or "").split("\n")] for t in texts]
    docs = {}
    for i, ks in enumerate(keys):
        for k in set(ks):
            docs.setdefault(k, set()).add(i)
    got = by_id(line_dedup.query(spark, path).collect())
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys[i]) if not (k and len(docs[k]) >= 10)]
        want = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == want, i


def test_first_occurrences_stay(spark):
    rows = [(3, "one line\nx3"), (1, "one line\nx1\none line"), (2, " ONE LINE \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, min_chars=3, min_docs=2)).collect())
    assert {k: r.text for k, r in out.items()} == {1: "one line\nx1", 2: "", 3: "x3"}


def test_hot_line_over_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('hot line here\nown line number ', id) AS text")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    maps = line_dedup.keep_bitmaps(docs, min_chars=1, min_docs=10, keep_first=False).collect()
    first = line_dedup.keep_bitmaps(docs, min_chars=1, min_docs=10, keep_first=True).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(maps) == 3000 and all(line_dedup.unpack(r.bitmap, 2).tolist() == [False, True] for r in maps)
    assert sorted(r.id for r in first) == list(range(1, 3000))


def fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(keys, near):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, sf):
    path, texts = sf
    fps = {i: fingerprint(t, 4) for i, t in enumerate(texts)}
    want = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = by_id(simhash.query(spark, path).collect())
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (fps[i], want[i]) for i in fps}
    assert all(len(r.fingerprint) == 16 for r in got.values())


def test_pair_links_lose_none_even_in_split_buckets(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3, dtype=np.int64)
    fps = sorted({int(b) ^ int(sum(1 << int(i) for i in rng.choice(60, 2, replace=False))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(x, x) for x in fps], "fp long, w0 long")
    was, simhash.BLOCK = simhash.BLOCK, 16
    try:
        label = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    finally:
        simhash.BLOCK = was
    want = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {x: label.get(x, x) for x in fps} == want


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "zz yy xx ww vv uu"), (None, "q w e r t y u i"), (None, "another text of no id"), (None, "another text of no id"), (4, "one text of id four"), (4, "this one is not like it")]
    # columns whose names clash with the operator's own
    docs = spark.createDataFrame([(*r, i, i, i) for i, r in enumerate(rows)], "doc_id long, text string, node int, row_id int, _1 int")
    kept = simhash.keep_one(docs, simhash.labelled(docs))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted({((i or 0), t) for i, t in rows if i != 2})
    assert simhash.keep_one(docs.limit(0), simhash.labelled(docs.limit(0))).count() == 0


def test_more_fingerprints_make_longer_keys_that_lose_no_link():
    rng = np.random.default_rng(7)
    for n, bits in ((1000, 2 * 10), (1 << 30, 3 * 9), (1 << 40, 4 * 8)):  # whole blocks of 64 bits cut in 6, 7 or 8
        masks = simhash.block_masks(n, 4)
        assert min(m.bit_count() for m in masks) >= bits
        for _ in range(300):
            gap = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(not gap & m for m in masks)


def test_warc(spark, sf):
    path, _ = sf
    pages = pq.read_table(f"{path}/pages.parquet").to_pylist()
    import base64

    body = {p["page_id"]: (p["html"] or "").encode() for p in pages}
    got = by_id(warc.query(spark, path).collect(), "page_id")
    for i, b in body.items():
        lead = min(j for j, x in body.items() if x == b)
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if lead == i else "revisit", None if lead == i else lead)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want


def test_warc_lookup_reads_by_the_index(spark, sf, tmp_path):
    path, _ = sf
    was, warc.LINES = warc.LINES, 2
    try:
        folder = f"file://{tmp_path}/warc"
        shards = warc.build_index(warc.write_archives(spark.read.parquet(f"{path}/pages.parquet"), folder), folder)
        urls = spark.createDataFrame([("http://a.b.c/x?y",), ("https://q.org/",), ("http://none.org/",)], "url string")
        found = {(r.asked, r.page_id): bytes(r.payload) for r in warc.lookup(shards, folder, urls).collect()}
    finally:
        warc.LINES = was
    # scheme, fragment and www don't count; revisits carry no payload
    assert found == {("http://a.b.c/x?y", 0): b"", ("http://a.b.c/x?y", 5): b"x" * 100_000, ("https://q.org/", 3): b"<p>same</p>"}
    import glob
    import gzip

    for f in glob.glob(f"{tmp_path}/warc/*.warc.gz"):
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert warc.surt("http://www.Ex.COM:80/a?b#c") == "com,ex)/a?b"


def test_token_counts(spark, sf):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    path, texts = sf
    got = by_id(token_counts.query(spark, path).collect())
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), i


def test_token_counts_of_random_marks():
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    count = token_counts.Counter(token_counts.Merger(token_counts.read_pieces(path)))
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeéñ the\n \t.▁aeiou<>日") for _ in range(rng.randint(0, 700))) for _ in range(300)]
    assert count(pa.array(texts))[1].tolist() == [len(x) for x in sp.encode(texts)]


def test_top_k(spark, sf):
    path, _ = sf
    rows = pq.read_table(f"{path}/embeddings.parquet").to_pylist()
    v = {r["vec_id"]: [math.floor(64 * x) for x in r["embedding"]] for r in rows if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        near = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:20]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(near)}
    was, vafile.BLOCK, vafile.QUERY_BLOCK = (vafile.BLOCK, vafile.QUERY_BLOCK), 16, 2
    try:
        assert {tuple(r) for r in vafile.query(spark, path).collect()} == want
    finally:
        vafile.BLOCK, vafile.QUERY_BLOCK = was


@pytest.mark.parametrize("most", [100, 10**4, 10**6, 10**9])
def test_wide_cells_still_give_exact_results(most):
    rng = np.random.default_rng(2)
    x = rng.integers(-most, most, (400, 5))
    low, width = x.min(axis=0), -(-(np.ptp(x, axis=0) + 1) // 256)
    kind = vafile.place_kind(width)
    cells = ((x - low) // width).astype(np.uint8)
    places = ((x - low) % width).astype(kind) if kind else np.zeros((400, 0), np.uint8)
    assert (vafile.exact(cells, places, low, width) == x).all()
    q, m, s, read = vafile.search_block(cells, places, np.arange(400), cells[:10], places[:10], np.arange(10), low, width, 7)
    for i in range(10):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(400) if j != i)[:7]
        assert [(-b, a) for c, a, b in zip(q, m, s) if c == i] == want
    assert read < 10 * 400  # bounds rule most vectors out


@pytest.fixture(scope="module")
def prose():
    return "word " * 400 + license_scan.TEMPLATES["mit"] + " more. " + license_scan.TEMPLATES["isc"].upper() + " é " + license_scan.TEMPLATES["mit-line"]


def test_license_scan(spark, prose):
    edited = license_scan.TEMPLATES["mit"].replace("without restriction", "with no restriction whatsoever").replace("free of charge, ", "")
    docs = spark.createDataFrame([(1, prose), (2, None), (3, ""), (4, "é\n" + edited), (5, "the license is here"), (6, "Released under the MIT License.\n" * 3)], "doc_id long, text string")
    got = license_scan.scan(docs).orderBy("doc_id", "span_start").collect()
    spans = {(r.doc_id, r.template): r for r in got}
    assert set(spans) == {(1, "mit"), (1, "isc"), (1, "mit-line"), (4, "mit"), (6, "mit-line")}
    assert prose[spans[1, "isc"].span_start : spans[1, "isc"].span_end] == license_scan.TEMPLATES["isc"].upper().rstrip(".")
    assert spans[1, "mit"].coverage == 1.0 and 0.9 < spans[4, "mit"].coverage < 1.0
    assert ("é\n" + edited)[spans[4, "mit"].span_start :].startswith("Permission is hereby")
    assert [r.span_start for r in got if r.doc_id == 6] == [0, 32, 64]


def test_alignment_against_a_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        t = rng.integers(0, 6, rng.integers(1, 14)).astype(np.uint64)
        x = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64)
        d = np.zeros((len(t) + 1, len(x) + 1), int)
        d[:, 0] = np.arange(len(t) + 1)
        for i in range(1, len(t) + 1):
            for j in range(1, len(x) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (t[i - 1] != x[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        matched, a, b = license_scan.align(t, x, 0, 64)
        assert 0 <= a <= b <= len(x) and matched >= len(t) - d[-1].min()


def test_license_scan_finds_what_plain_search_finds(spark):
    """Exact copies of every template, in any case and spacing, repeated, in long texts and in several of them."""
    rng = random.Random(11)
    words = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    rows, want = [], {}
    for i in range(120):
        parts, n = [], rng.randint(0, 4)
        for _ in range(n):
            parts += ["x" + " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 400))), rng.choice([str, str.upper, str.title])(rng.choice(list(license_scan.TEMPLATES.values()))).replace(" ", rng.choice([" ", "  ", "\n", " * "]))]
        rows.append((i, "\n".join(parts)))
        text = words(rows[-1][1])
        for name, template in license_scan.TEMPLATES.items():
            t = words(template)
            at = [j for j in range(len(text) - len(t) + 1) if text[j : j + len(t)] == t]
            if at:
                want[i, name] = len(at)
    docs = spark.createDataFrame([*rows, rows[0], rows[5]], "doc_id long, text string")
    got = {}
    for r in license_scan.scan(docs).filter("coverage = 1").collect():
        got[r.doc_id, r.template] = got.get((r.doc_id, r.template), 0) + 1
    assert len(want) > 150 and got == {k: n * (2 if k[0] in (0, 5) else 1) for k, n in want.items()}


def test_license_scan_recall_of_edited_copies(spark):
    """Copies with words changed, left out or put in, that a plain alignment puts at a coverage of 0.8 or more."""
    rng = random.Random(13)
    rows, want = [], set()
    for i in range(200):
        name = rng.choice(sorted(license_scan.TEMPLATES))
        w = re.findall(r"[0-9A-Za-z]+", license_scan.TEMPLATES[name])
        edits = rng.randint(0, max(1, len(w) // 8))
        for _ in range(edits):
            j, kind = rng.randrange(len(w)), rng.randrange(3)
            w[j : j + (kind < 2)] = [] if kind == 0 else [f"edit{rng.randint(0, 99)}"]
        rows.append((i, " ".join(["before"] * 30 + w + ["after"] * 30)))
        hasher = license_scan.SpanHash()
        template, text = (next(h for *_, h, _ in license_scan.word_hashes(pa.array([t]), hasher)) for t in (license_scan.TEMPLATES[name], " ".join(w)))
        matched, _, _ = license_scan.align(template, text, 0, len(template) + len(text))
        if matched >= 0.8 * len(template):
            want.add((i, name))
    got = {(r.doc_id, r.template) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 100 and len(want & got) >= 0.98 * len(want)


def test_templates_shorter_than_a_gram(spark):
    docs = spark.createDataFrame([(1, "x\nAll rights reserved.\ny ALL RIGHTS, RESERVED"), (2, "all rights"), (3, "all rights are reserved"), (4, "one word")], "doc_id long, text string")
    got = [(r.doc_id, r.template, r.span_start, r.span_end) for r in license_scan.scan(docs).orderBy("doc_id", "span_start").collect()]
    assert got == [(1, "all-rights-reserved", 2, 21), (1, "all-rights-reserved", 25, 45)]
    one = license_scan.scan(docs, {"w": "Word", "none": "..."}).collect()
    assert [(r.doc_id, r.template, r.span_start) for r in one] == [(4, "w", 4)]


def test_edited_copies_of_short_templates(spark):
    """Every change and every omission of as many words as min_coverage allows."""
    from itertools import combinations

    short = {k: re.findall("[A-Za-z0-9]+", v) for k, v in license_scan.TEMPLATES.items() if len(v) < 100}
    rows, want = [("Licensed under the MIT License.",), ("Distributed under the MIT License.",)], {("Licensed under the MIT License.", "mit-line"), ("Distributed under the MIT License.", "mit-line")}
    for name, words in short.items():
        for at in combinations(range(len(words)), len(words) - math.ceil(0.8 * len(words))):
            for put in (["edit"], []):
                text = " ".join(x for i, w in enumerate(words) for x in (put if i in at else [w]))
                rows.append((f"some text {text} and more",))
                want.add((rows[-1][0], name))
    docs = spark.createDataFrame(rows, "text string")
    got = license_scan.scan(docs, id_col="text").collect()
    assert want <= {(r.text, r.template) for r in got} and all(r.coverage >= 0.8 for r in got)


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 50, 200).astype(np.uint64)
    kept = set(license_scan.winnow(g).tolist())
    assert all(kept & set(range(i, i + license_scan.WINNOW)) for i in range(200 - license_scan.WINNOW + 1))


def test_quality(spark):
    rng = random.Random(2)
    good = ["river", "stone", "light", "walks", "deep", "green", "and", "the", "of", "over"]
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choice(good) + ("%%%" if bad else "") for _ in range(80))
        docs.append((i, text))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    d = spark.createDataFrame([*docs, (600, None), (601, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(quality.resampled(d, lab).collect())
    unlabelled = [i for i in range(600) if i % 2 and i % 5]
    assert all(got[i].kept for i in unlabelled) and got[600].kept and got[601].log_importance == 0.0
    assert not any(got[i].kept for i in range(0, 600, 4))
    assert {r.doc_id for r in quality.keep_sampled(d, lab).collect()} == {i for i, r in got.items() if r.kept}
    none = quality.resampled(d, lab.limit(0)).filter("NOT kept").count()
    assert none == 0


def plain_quality(rows, labels, spare=0.9999):
    """{(id, text): (log importance, weight)} and the expected number kept, in plain Python."""
    hasher = quality.SpanHash()

    def grams(text):
        tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^\s0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        raw = [t.encode() for t in tokens]
        h = [int(hasher(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in raw]
        pairs = [int(quality.mix(np.array([(3 * a + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        again = any(h[i] == h[i + s] == h[i + 2 * s] for s in (1, 2) for i in range(len(h) - 2 * s))
        return {*h, *pairs, *([7] if again else [])}

    of = [grams(t) for _, t in rows]
    good = {i for i, _ in rows if i is not None and [x for x in labels if x[0] == i] and all(q == 1 and not x for j, q, x in labels if j == i)}
    count = {}
    for (i, _), g in zip(rows, of):
        for h in g:
            for bucket in (h % quality.BUCKETS, quality.BUCKETS + (h >> 24) % quality.BUCKETS):
                count.setdefault(bucket, [0, 0])[0] += 1
                count[bucket][1] += i in good
    share, ratio = sum(i in good for i, _ in rows) / len(rows), {}
    least = next(t / 4 for t in range(200) if sum(raw * share >= t / 4 for raw, _ in count.values()) * math.exp(-t / 4) <= 1)
    for b, (raw, g) in count.items():
        e = raw * share
        if g < e and e - g + (g * math.log(g / e) if g else 0) > least:
            ratio[b] = math.log((g + 0.5) / (e + 0.5))
    out = {}
    for row, g in zip(rows, of):
        out[row] = sum(max(ratio.get(h % quality.BUCKETS, 0), ratio.get(quality.BUCKETS + (h >> 24) % quality.BUCKETS, 0)) for h in g)
    return out, sum(1 - (1 - spare) ** math.exp(out[r]) for r in rows)


def test_quality_against_a_plain_one(spark):
    rng = random.Random(12)
    words = "river stone light walks deep green and the of over".split()
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) + rng.choice(["", "", ",", "x", "é"]) for _ in range(rng.randint(1, 60))]
        if i % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["scum", "odd", "§§"])
        if i % 10 == 0:
            w += ["on"] * 5
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 10 > 0), int(i % 6 == 0)))
    rows += [(900, None), (901, ""), (None, "scum of a text"), (None, "river"), (0, "another text of id 0"), *rows[1:4]]
    labels += [(1, 1, None), (2, None, 0), (None, 0, 0)]
    docs = spark.createDataFrame([(*r, 0.5, True, 1) for r in rows], "doc_id long, text string, log_importance double, kept boolean, _good int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, k = plain_quality(rows, [x for x in labels if x[0] is not None and x[1] is not None])
    assert len({round(x, 3) for x in want.values()}) > 5
    got = quality.resampled(docs, lab).collect()
    assert sorted((str(r.doc_id), round(r.log_importance, 2)) for r in got) == sorted((str(r[0]), round(want[r], 2)) for r in rows)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert {r.kept for r in got} == {True, False} and sum(r.kept for r in got) >= math.ceil(k)
    assert all(r.kept == (r.gumbel_key >= keys[math.ceil(k) - 1]) for r in got)
    stay = quality.keep_sampled(docs, lab)
    assert stay.columns == docs.columns and stay.count() == sum(r.kept for r in got)


def test_the_noise_decides_and_the_sample_nears_the_target(spark):
    """Documents of middling weight are kept as often as importance resampling says, and n-grams that the
    target lacks are rarer among the documents kept than among all."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(400)]  # so many that no pair with "rare" is frequent
    rows, labels = [], []
    for i in range(6000):
        odd = i % 5 == 0
        rows.append((i, " ".join([rng.choice(words) for _ in range(12)] + ["rare"] * odd)))
        labels.append((i, int(not odd or i % 25 == 0), 0))  # the target holds a fifth of them
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.resampled(docs, lab, spare=0.99).collect()}
    some = [r for i, r in got.items() if i % 5 == 0]
    weight = math.exp(some[0].log_importance)
    assert 0.1 < weight < 0.5 and all(r.log_importance == some[0].log_importance for r in some)
    kept = sum(r.kept for r in some) / len(some)
    assert abs(kept - (1 - 0.01**weight)) < 0.04 and 0.05 < kept < 0.95
    assert all(r.log_importance == 0 for i, r in got.items() if i % 5)
    share = sum(r.kept for r in some) / sum(r.kept for r in got.values())
    assert share < 0.9 * 0.2


def test_labels_beyond_the_bound_are_a_sample(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a' AS text")
    lab = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    n = quality.with_labels(docs, lab, "doc_id", max_labels=1000).filter("_good IS NOT NULL").count()
    assert 850 < n < 1150


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=500) * 1e3, np.zeros(200), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "k double")
    for k in (1, 2, 250, 400, 701):
        assert quality.kth_largest(df, "k", k, bins=16) == np.sort(x)[::-1][k - 1]
    assert quality.kth_largest(df, "k", 0) == np.inf and quality.kth_largest(df, "k", 702) == -np.inf


def test_forward_backward_against_a_plain_one():
    rng = np.random.default_rng(0)
    k = 3

    def plain(sc, step, start):
        lse = lambda x, ax: np.log(np.exp(x - x.max()).sum(ax)) + x.max()
        n = len(sc)
        a, b = np.zeros((n, k)), np.zeros((n, k))
        a[0] = start + sc[0]
        for t in range(1, n):
            a[t] = sc[t] + lse(a[t - 1][:, None] + step, 0)
        for t in range(n - 2, -1, -1):
            b[t] = lse(step + (sc[t + 1] + b[t + 1])[None, :], 1)
        x = np.exp(a + b - (a + b).max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    was, langid.SEGMENT = langid.SEGMENT, 5
    try:
        lengths = [1, 3, 5, 6, 17, 2, 30, 10]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        sc, step, start = rng.normal(size=(bounds[-1], k)) * 2, rng.normal(size=(k, k)) - 2 * (1 - np.eye(k)), rng.normal(size=k)
        got = langid.forward_backward(sc, bounds, step, start)
    finally:
        langid.SEGMENT = was
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert np.abs(got[a:b] - plain(sc[a:b], step, start)).max() < 1e-9


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "wh", "ou", "th"], "de": ["sch", "ung", "ein", "ü", "keit", "zu"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(3, 60))), lang) for i in range(400) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame([*rows, (400, None, "en"), (401, "123 !!", None), (402, "…—", None)], "doc_id long, text string, lang string")
    train = docs.filter(~langid.held_out(docs.doc_id) & docs.lang.isNotNull() & docs.text.isNotNull()).select("text", "lang")
    model = langid.train_model(train)
    got = by_id(langid.predict(docs, model).collect())
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3
    mixed = " ".join([word("en") for _ in range(12)] + [word("de") for _ in range(12)])
    labels = [x for _, x, _ in langid.word_labels(model, mixed)]
    assert labels[:10] == ["en"] * 10 and labels[-10:] == ["de"] * 10


def test_the_sample_is_the_smallest_hashes_of_each_language(spark):
    rows = [(f"text {i}", "en" if i % 3 else "de") for i in range(3000)] + [("a very common text", "en")] * 4000 + [("few", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    per_lang = {"en": 6000, "de": 1000, "fr": 1}
    got = {(r.lang, r.text) for r in langid.sample_docs(df, per_lang).collect()}
    top = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) >> 11, t)
    want = {(x, t) for x in ("en", "de") for t in sorted({t for t, lang in rows if lang == x}, key=top)[: langid.SAMPLE_DOCS]} | {("fr", "few")}
    assert got == want


def test_operators_run_where_workers_lack_the_package(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "alone.py"
    script.write_text(f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.range(1).rdd.map(lambda x: 1).collect()  # workers start before the path is known
sys.path.insert(0, {root!r})
from sparkloom.llm import langid, license_scan, quality, simhash, token_counts
docs = spark.createDataFrame([(i, "Released under the MIT License. the text " + w) for i, w in enumerate(["one", "two", "ein", "zwei"])], "doc_id long, text string")
train = docs.selectExpr("text", "if(doc_id < 2, 'en', 'de') AS lang")
print("ROWS", license_scan.scan(docs).count(), langid.predict(docs, langid.train_model(train)).count(), quality.resampled(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).count(), simhash.near_duplicates(docs).count(), token_counts.token_counts(docs).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 4 4 4 4 4" in out.stdout, out.stderr[-2000:]


def test_templates_beyond_the_bound_are_scanned_for_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(license_scan.TEMPLATES.values()))], "doc_id long, text string")
    rows = lambda: sorted(license_scan.scan(docs).collect())
    want = rows()
    monkeypatch.setattr(license_scan, "MAX_TEMPLATE_WORDS", 40)
    assert rows() == want and len(want) >= len(license_scan.TEMPLATES)


def test_language_held_out_fold(spark, sf):
    path, texts = sf
    got = by_id(langid.query(spark, path).collect())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(len(texts)))
    assert got[0].lang_pred == "und" and got[1].lang_pred == "und" and got[5].lang_pred in ("en", "de")
