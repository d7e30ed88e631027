"""Queries with SQL against DuckDB on odd tables, and the pipeline stage by stage."""

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_contracts import corpus

from sparkloom.llm import decontaminate, mixing, queries


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    d = tmp_path_factory.mktemp("sql")
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    texts = [t for t in corpus() if t is None or len(t) < 20_000]
    texts += ["begin " + item + " end", item.upper().replace(" ", ", "), " ".join(item.split()[:12]), item.replace("eight", "oops")]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([["en", "de", None][i % 3] for i in range(n)]), "source": pa.array(["hot" if i % 3 else f"s{i % 5}" for i in range(n)]), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1, 2], pa.int64()), "text": pa.array([item, "", texts[40]])}), d / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(0, n, 2), pa.int64()), "quality": pa.array([1] * len(range(0, n, 2))), "toxic": pa.array([0] * len(range(0, n, 2)))}), d / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(50), pa.int64()), "embedding": pa.array([[float(i % 7), -float(i % 5)] for i in range(50)], pa.list_(pa.float32()))}), d / "embeddings.parquet")
    pq.write_table(pa.table({"page_id": pa.array([5, 3, 3, 9], pa.int64()), "url": pa.array(["a", "b", "b", None]), "html": pa.array(["x", "y", "y", "x"])}), d / "pages.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else x
    rows = lambda f: sorted(repr([plain(x) for x in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contained_items(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(item.split()[:20])), (3, " ".join(item.split()[:19])), (4, None), (None, item), (6, item.upper()), (6, item.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, "four words are short"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, 7): (20, 20), (2, 7): (20, 16), (None, 7): (20, 20), (6, 7): (20, 20)}
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(docs, items).collect()) == ["3", "4"]


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "x FOUR words, are short y"), (2, "four words are long"), (3, "one"), (4, "words are"), (5, "a pair of five words here now")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "four words are short"), (2, "One!"), (3, "are short"), (4, " ... "), (5, "pair of five words here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, 1, 1), (3, 2, 1), (1, 3, 1), (5, 5, 1)}
    assert decontaminate.contained_items(docs, items.filter("item_id = 4")).count() == 0


def test_contaminated_rows_go_alone_whatever_their_ids(spark):
    item = "one two three four five six seven"
    rows = [(1, item), (1, "clean text of id one"), (None, "x " + item), (None, "clean text of no id"), (None, None), (2, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row_id int, v int, doc int")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {rows[1], *rows[3:]}


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "en", "p", 100), ("a", "de", "p", 50), ("b", "en", "p", 10), ("b", "de", "q", 40), ("a", "en", "q", 30)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"p": 0.7, "q": 0.3}}
    out = mixing.rake(cells, targets, fraction=0.2, tolerance=1e-3, gain=0.0, rounds=60).collect()
    assert all(0 <= r.weight <= r.tokens for r in out)
    for i, dim in enumerate(("source", "lang", "topic")):
        for value, share in targets[dim].items():
            assert abs(sum(r.weight for r in out if r[i] == value) / (0.2 * 230) - share) < 1e-3


def test_what_a_margin_lacks_is_spread_over_the_others(spark):
    """Plain bounded raking in Python gives the same, where one source has less than is wanted of it."""
    import random

    rng = random.Random(4)
    cells = [(s, x, t, rng.randint(1, 2000) if s != "tiny" else 3) for s in ("hot", "a", "b", "tiny") for x in ("en", "de") for t in ("p", "q", "r")]
    cells = [(s, x, t, n * 30 if s == "hot" else n) for s, x, t, n in cells]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"hot": 0.7, "a": 0.1, "b": 0.1, "tiny": 0.1}}
    got = {tuple(r[:3]): r.weight for r in mixing.rake(df, targets, fraction=0.1, tolerance=1e-4, gain=0.0, rounds=50).collect()}
    total = sum(n for *_, n in cells)
    have = {s: sum(n for c, _, _, n in cells if c == s) for s in targets["source"]}
    rest = (0.1 * total - have["tiny"]) / 0.9
    want = {s: have[s] if s == "tiny" else share * rest for s, share in targets["source"].items()}
    for s, w in want.items():
        assert abs(sum(v for k, v in got.items() if k[0] == s) / w - 1) < 2e-3
    for i in (1, 2):  # tempered shares of the other margins
        by = {v: sum(c[3] for c in cells if c[i] == v) for v in {c[i] for c in cells}}
        for v, n in by.items():
            share = n**mixing.ALPHA / sum(m**mixing.ALPHA for m in by.values())
            assert abs(sum(x for k, x in got.items() if k[i] == v) / (share * 0.1 * total) - 1) < 2e-3
    assert sum(v for k, v in got.items() if k[0] == "tiny") > 0.99 * have["tiny"]


def test_sampled_margins_come_near_the_targets(spark):
    import random

    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30) + ["!!"] * (i % 7 == 0)), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b"])) for i in range(12_000)]
    docs = spark.createDataFrame([(*r, "x", 1, True, 0.5) for r in rows], "doc_id long, text string, lang string, source string, topic string, cell int, kept boolean, probability double")
    found = mixing.mixed(mixing.measured(docs), fraction=0.6)
    assert found.columns[: len(docs.columns)] == docs.columns and found.count() == docs.count()
    margins = mixing.achieved(found, fraction=0.6).collect()
    assert {r.dimension for r in margins} == {"source", "lang", "topic"} and "" in {r.value for r in margins}
    for r in margins:
        assert abs(r.expected / r.want - 1) <= 1.1 * mixing.TOLERANCE and abs(r.sampled / r.want - 1) < 0.06


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    last = p.STAGES[-1][1](spark, docs, sf)
    assert set(columns) < set(last.columns) and last.count() <= before
    texts = [r.text for r in docs.collect()]
    assert not any(t and "one two three four five six seven eight nine ten eleven twelve thirteen fourteen" in t for t in texts)
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_near_copies_of_the_pipeline(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(3)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(300)) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        w = b.split()
        rows += [(10 * i, b), (10 * i + 1, b), (10 * i + 2, " ".join(["changed" if j in (50, 150) else x for j, x in enumerate(w)]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.near_dedup_stage(spark, docs, "").collect()) == [10 * i for i in range(12)]


def test_isolated_near_copies_of_the_pipeline(spark):
    import random

    import corpus_pipeline as p
    from sparkloom.llm import simhash

    rng = random.Random(8)
    rows, max_bits = [], int(p.FINGERPRINT_BITS * (1 - p.SIMILARITY))
    for i in range(300):
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        at, n = rng.randint(20, 240), rng.randint(21, 28)
        b = a[:at] + [f"x{rng.randint(0, 10**6)}" for _ in range(n)] + a[at + n :]
        x, y = ({tuple(t[j : j + 5]) for j in range(296)} for t in (a, b))
        assert 0.8 <= len(x & y) / len(x | y) <= 0.85
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    fp = {r.id: [x & (2**64 - 1) for x in r[1:]] for r in simhash.fingerprints(docs, bits=p.FINGERPRINT_BITS).collect()}
    alike = {i for i in range(0, 600, 2) if sum((x ^ y).bit_count() for x, y in zip(fp[i], fp[i + 1])) <= max_bits}
    assert len(alike) > 250
    kept = {r.doc_id for r in p.near_dedup_stage(spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(600)) - {i + 1 for i in alike}


def test_passages_of_few_documents(spark, sf):
    import random

    import corpus_pipeline as p

    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passages = {k: prose(51) for k in range(2, 10)} | {10: prose(5000)}
    short, rows, first, i = prose(50), [], {}, 0
    for k, passage in passages.items():
        first[k] = i
        for _ in range(min(k, 2) if k == 10 else k):
            own = prose(200 if k < 10 else 9000)
            rows.append((i, f"{own[:300]}\n{passage.upper() if i % 2 else passage}\n{own[300:]}"))
            i += 1
    rows += [(i, prose(200) + "\n" + short), (i + 1, prose(200) + "\n" + short)]
    copy = [prose(60) for _ in range(8)]
    rows += [(i + 2, "\n".join(copy)), (i + 3, "\n".join(copy + [prose(3)]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (p.line_stage, p.near_dedup_stage, p.decontamination_stage):
        docs = p.cut(stage(spark, docs, sf), "passages")
    out = {r.doc_id: r for r in docs.collect()}
    for k, passage in passages.items():
        assert [d for d in sorted(out) if passage in out[d].text.lower()] == [first[k]]
    assert sum(short in r.text for r in out.values()) == 2 and all(r.n_chars == len(r.text) for r in out.values())
    assert set(out) == set(range(i + 3)) and out[i + 2].text == "\n".join(copy)
