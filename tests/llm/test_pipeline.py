"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from test_near_duplicates import brute
from test_substring_dedup import exact_repeats, words
from test_text_models import distance
from test_tokens import WORD, check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "12 34 !!", "en", "s", 8), (90_002, None, None, None, None), (None, "words without an id", "en", "s", 19)], docs.schema)
    docs = docs.unionByName(extra)
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), f"test-{name}"))
        if name != "packing":
            assert tables[-1].columns == docs.columns and tables[-1].dtypes == docs.dtypes
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables[:-1]]
    given, language, near, substrings, clean = rows
    assert set(given) - set(language) == {90_001, 90_002}
    keep = {i for i, c, _ in brute(list(language.items())) if i == c}
    assert {i if i is not None else -1 for i in near} == keep | {-1}
    later, _ = exact_repeats([(i, t) for i, t in substrings.items() if i is not None])
    assert not later and set(substrings) <= set(near)
    changed, _ = exact_repeats([(i, t) for i, t in near.items() if i is not None])
    assert set(changed) <= {i for i in near if substrings.get(i) != near[i]} and len(changed) < len(near) / 4
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in substrings.items() if i is not None and any(distance(m, words(t)) <= int(0.2 * len(m)) for m in items)}
    assert set(substrings) - set(clean) == leaks and leaks
    t = Tokenizer.from_file(WORD)
    check_packing(tables[-1].collect(), {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in clean.items()}, 2048)


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "again")
    pick = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, SF)) == pick(docs)


def test_stages_with_clashing_columns(spark):
    words_of = lambda n, k: " ".join(f"word{(i * 7 + n * 13) % 997}" for i in range(k))
    docs = spark.createDataFrame(
        [(i, words_of(i, 40 + i), "en" if i % 3 else None, "s", 1, None, "a", 2, "b", None, 3) for i in range(30)] * 2 + [(None, None, None, None, None, None, None, None, None, None, None), (99, "x " * 5000, "en", None, None, None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, text_hash int, cuts string, cut_id int, item_id int",
    )
    for stage in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES:
            out = materialize(f(spark, stage, SF), "clash")
            if name != "packing":
                assert out.dtypes == docs.dtypes
                stage = out
        assert out.select("doc_id").distinct().count() == stage.select("doc_id").distinct().count()


def test_one_id_with_two_texts(spark):
    """Each text of an id is judged by itself."""
    words_of = lambda seed: " ".join(f"word{(i * 7 + seed * 131) % 997}" for i in range(80))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = words_of(1), words_of(2), words_of(3)
    rows = [(3, a), (7, a + " more"), (7, b), (9, c), (9, c + " " + item), (None, words_of(5)), (12, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = materialize(corpus_pipeline.near_duplicates(spark, docs, SF), "two")
    assert sorted((r.doc_id or 0, r.text[:9], len(r.text)) for r in near.collect()) == sorted((i or 0, t[:9], len(t)) for i, t in rows if t not in (a + " more",) and (i, t) != (12, a))
    clean = materialize(corpus_pipeline.decontaminate(spark, docs, SF), "two")
    assert sorted((r.doc_id or 0, len(r.text)) for r in clean.collect()) == sorted((i or 0, len(t)) for i, t in rows if item not in t)
    left = {(r.doc_id, r.text) for r in materialize(corpus_pipeline.substrings(spark, docs, SF), "two").collect()}
    assert left >= {(3, a), (7, b)} and sum(c in t for i, t in left if i == 9) == 1  # of the two of document 9 one keeps c
