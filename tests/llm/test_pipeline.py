"""The pipeline's stages and the registered queries."""

import duckdb

import corpus_pipeline

from arborql.llm import near_dedup
from arborql.llm.queries import ORACLE_SQL, QUERIES


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    words = lambda *a: " ".join(f"word{i} the of" for i in range(*a))
    item = "the benchmark asks one question of exactly twelve words in this line"
    rows = [(0, words(60), "en"), (1, words(60), "en"), (2, "12345", "en"), (3, None, None), (4, words(100, 150) + " " + item, "en"), (5, words(200, 260) + " mail a.b@c.org", "en"), (6, words(300, 340), "en"), (7, words(400, 440), "en")]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        left.append({r.doc_id for r in at.collect()})
    assert left == [{0, 1, 4, 5, 6, 7}, {0, 4, 5, 6, 7}, {0, 5, 6, 7}, {0, 5, 6, 7}]
    assert "a.b@c.org" not in "".join(r.text for r in at.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {0, 5, 6, 7}
    assert len(corpus_pipeline.STAGES) == 5


def test_near_dedup_stage_drops_copies_from_four_fifths_on(spark):
    words = [f"w{i}" for i in range(400)]
    near = [f"x{i}" if i % 55 == 20 else w for i, w in enumerate(words)]  # 7 words changed: 361 of 431 shingles are common
    far = [f"y{i}" if i % 40 == 20 else w for i, w in enumerate(words)]  # 10 changed: 346 of 446
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, far))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2}
    assert near_dedup.near_duplicates(docs).where("kept").count() == 3  # op1_near_dedup links from 0.85 on


def brute_pipeline(docs, items):
    """The stages' decisions in plain Python, but for language ID and PII, which are given. docs: doc_id -> text."""
    import re

    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := cut(t)) else set() for i, t in docs.items()}
    group = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = {i for i in docs if group[i] == i}
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    windows = [w[k : k + 10] for item in items for w in [words(item)] for k in range(max(1, len(w) - 9)) if w]
    holds = lambda w: any(w[k : k + len(p)] == p for p in windows for k in range(len(w)))
    return kept, {i for i in kept if not holds(words(docs[i]))}


def test_stages_equal_brute_force(spark, tmp_path):
    import random

    r = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("the", "river", "stone", "and", "house", "winter") for b in ("", "s", "ly", "ing")]
    base = [" ".join(r.choices(vocabulary, k=120)) for _ in range(12)]
    docs = {}
    for t in base:
        docs[len(docs)] = t
        for _ in range(r.randrange(3)):
            w = t.split()
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = "changed"
            docs[len(docs)] = " ".join(w)
    items = [" ".join(base[3].split()[20:40]), "no document holds this item of eight words", "short item"]
    docs[len(docs)] = base[5] + " a short item at the end"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(n, x) for n, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, clean = brute_pipeline(docs, items)
    first = corpus_pipeline.near_duplicates(spark, table, str(tmp_path))
    assert {x.doc_id for x in first.collect()} == kept
    assert {x.doc_id for x in corpus_pipeline.decontamination(spark, first, str(tmp_path)).collect()} == clean
    assert len(clean) < len(kept) < len(docs)


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, an empty table."""
    long = " ".join(f"word{i} the of and" for i in range(30_000))
    rows = [(0, "the house of the river and the stones in it", "en"), (0, "the house of the river and the stones in it", "en"), (1, long, "en"), (2, None, None), (3, "", "en"), (None, "the null id of a river and of a stone", "en"), (4, "the winter is cold and the river is not so warm", None), (5, "12 34", "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, w array<string>, tid long, score double, run long"
    docs = spark.createDataFrame([(i, t, l, None, None if t is None else len(t), ["x"], 1, 0.5, None) for i, t, l in rows], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = []
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.schema == docs.schema or at.columns == docs.columns, name
        left.append(sorted(str(x.doc_id) for x in at.collect()))
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert left == [["0", "0", "1", "4", "None"], *[["0", "1", "4", "None"]] * 3]
    pieces = corpus_pipeline.pack(spark, at, str(tmp_path)).collect()
    assert {str(x.doc_id) for x in pieces} == {"0", "1", "4", "None"} and max(x.start for x in pieces) > 2048
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert {x.doc_id: x.doc_tokens for x in corpus_pipeline.pack(spark, docs, str(tmp_path)).where("doc_id in (2, 3)").collect()} == {2: 1, 3: 1}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_op3_decontamination_equals_its_sql_by_columns_and_rows(spark, tmp_path):
    item = "The benchmark asks one question of exactly twelve words in this line"
    texts = [None, "", "...", item, "A short ITEM", "the benchmark asks, one question of exactly inserted twelve words in this line", f"pre {item} and a short item post", "Élan " * 40]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([(10, item), (9, "short item"), (8, None), (7, "")], "item_id long, text string")
    db = duckdb.connect()
    for name, table in (("documents", documents), ("benchmark", benchmark)):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = QUERIES["op3_decontamination"](spark, str(tmp_path))
    same = db.execute(ORACLE_SQL["op3_decontamination"])
    assert found.columns == [c[0] for c in same.description]
    assert sorted(map(tuple, found.collect())) == sorted(same.fetchall())


def test_materialize_hands_free_native_memory_back(spark, monkeypatch):
    """What the JVM's malloc holds though it is free: many deflaters, of which only the last one lives on."""
    from arborql.operators import tables

    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: sum(int(x.split()[1]) for x in open(f"/proc/{pid}/smaps_rollup") if x.startswith("Pss_Anon:")) / 1024
    monkeypatch.setattr(tables, "_DUE", {"at": float("inf")}, raising=False)
    deflaters = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for d in deflaters[:-1]:
        d.end()
    tables.materialize(spark.range(10))  # no trim is due
    kept = held()
    monkeypatch.setattr(tables, "_DUE", {"at": 0.0}, raising=False)
    assert tables.materialize(spark.range(10)).count() == 10
    assert kept - held() > 40
    deflaters[-1].end()
