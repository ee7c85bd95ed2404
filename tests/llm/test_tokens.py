"""Token operators against direct use of the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, repair_store, token_counts
from tidemark.llm.queries import QUERIES, vocabulary
from tidemark.llm.tokens import ChunkEncoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [None, "", " ", "  a", "a   b\n c", "a\n", "\n", "x\ny.\nz", "it's  <|endoftext|> z", "A <|STARTofTEXT|>", "don 't'. s'.", "A.,x 1.2,3!!?\" ('.')", "é́ 　 Σας", "b" * 5000]
SCHEMA = "doc_id long, text string, start string, salt int, length double"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", None, None) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_equal_whole_texts(path):
    own = ChunkEncoder(path)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("aBs t\n.,'!?1é́ \x00<|>-"), max_size=30), min_size=1, max_size=5))
    def check(texts):
        ids, offsets = own.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids

    check()


def expected_ids(spark, sf, path, end):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    t = Tokenizer.from_file(path)
    return {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [end] for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2_whole_table(spark):
    want, start = {}, 0
    for i, ids in expected_ids(spark, SF, BYTE, 2).items():
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_repair_token_ids"](spark, SF).collect()} == want


def test_op2_edges(spark):
    df = docs_of(spark, [*ODD, *ODD]).unionByName(spark.createDataFrame([(None, "n", "x", None, None), (3, "again", "x", None, None)], SCHEMA))
    out = repair_store.read_documents(repair_store.write_blocks(df, BYTE)).orderBy("start").collect()
    assert len(out) == df.count() and out[0].doc_id is None
    assert [r.start for r in out[1:]] == list(np.cumsum([r.n_tokens for r in out]))[:-1]
    assert repair_store.read_documents(repair_store.write_blocks(df.limit(0), BYTE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=400), min_size=1, max_size=6))
def test_repair_round_trip(lists):
    lists = [[*x, 2] for x in lists]
    ids, lengths = np.array(sum(lists, [])), np.array([len(x) for x in lists])
    data, _ = repair_store.pack_block(pa.array(range(len(lists))), ids, lengths)
    block = repair_store.Block(data)
    assert block.whole().tolist() == ids.tolist()
    for k, x in enumerate(lists):
        assert block.slice(k, len(x) // 3, len(x) // 2 + 1).tolist() == x[len(x) // 3 : len(x) // 2 + 1]


def pair_counts(ids, lengths):
    """Occurrences of each pair of neighbours inside documents, overlapping ones too."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    pairs = np.stack([ids[:-1], ids[1:]])[:, ~last[:-1]]
    return np.unique(pairs, axis=1, return_counts=True)[1]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 40), st.sampled_from([3, 6, 18]))
def test_repair_ends_when_no_pair_is_frequent(seed, symbols, bits):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 300, 20)
    ids = np.minimum(rng.geometric(0.2, lengths.sum()), symbols)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repair_store, "TABLE_BITS", bits)
        rest, parts, rules, rounds = repair_store.compress(ids, lengths, 1000)
    assert pair_counts(rest, parts).max(initial=0) < repair_store.MIN_COUNT and len(parts) == len(lengths) and rounds.sum() == rules.shape[1]
    out = rest.tolist()
    while any(x >= 1000 for x in out):
        out = [y for x in out for y in (rules[:, x - 1000].tolist() if x >= 1000 else [x])]
    assert out == ids.tolist()


def test_blocks_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(repair_store, "BLOCK_IDS", 50)
    docs = [(i, "word " * n) for i, n in enumerate([3, 5, 200, 7, 49, 1, 60, 2])]
    blocks = repair_store.write_blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), BYTE).collect()
    assert all(b.n_tokens <= 50 or b.n_docs == 1 for b in blocks) and sum(b.n_docs for b in blocks) == len(docs)


def test_repair_shrinks():
    ids = np.tile(np.arange(50), 2000)
    data, n = repair_store.pack_block(pa.array([7]), ids, np.array([len(ids)]))
    assert n < len(ids) / 10 and repair_store.Block(data).slice(0, 777, 1234).tolist() == ids[777:1234].tolist()


def test_a_real_block_is_smaller_than_its_ids(spark):
    ids = [np.array(x) for x in expected_ids(spark, "/root/testdata/sf0.1", BYTE, 2).values()]
    lengths = np.array([len(x) for x in ids])
    n = int(np.searchsorted(np.cumsum(lengths), repair_store.BLOCK_IDS, "right"))
    assert lengths[:n].sum() >= 0.5 * repair_store.BLOCK_IDS
    whole = np.concatenate(ids[:n])
    data, _ = repair_store.pack_block(pa.array(range(n)), whole, lengths[:n])
    block = repair_store.Block(data)
    assert np.array_equal(block.whole(), whole) and len(data) < 0.65 * 2 * len(whole), len(data) / 2 / len(whole)
    # every rule that is kept saves what it costs
    rest, _, rules, _ = repair_store.compress(whole, lengths[:n], 65536)
    assert len(rest) + 3 * rules.shape[1] <= len(whole)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1).map(lambda x: x >> (x % 32)), max_size=70))
def test_packed_numbers(numbers):
    data = b"xyz" + repair_store.pack_numbers(np.array(numbers, np.int64)) + b"rest"
    out, at = repair_store.unpack_numbers(data, 3)
    assert out.tolist() == numbers and data[at:] == b"rest"


def check_packing(rows, want, capacity):
    sequences, seen = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and crc(ids) == r.ids_crc32 and r.start == r.piece * capacity
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(x) for i, x in want.items()}
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_op7_whole_table(spark):
    want = expected_ids(spark, SF, WORD, 0)
    n = check_packing(QUERIES["op7_best_fit_packing"](spark, SF).collect(), want, 2048)
    assert n <= 1.02 * sum(map(len, want.values())) / 2048 + 1


def test_op7_edges(spark):
    df = docs_of(spark, ODD)
    t = Tokenizer.from_file(WORD)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(ODD)}
    check_packing(packing.pack(df, WORD, 16).collect(), want, 16)
    assert packing.pack(df.limit(0), WORD, 16).count() == 0
    assert packing.pack(df.unionByName(df), WORD, 16).count() == 2 * packing.pack(df, WORD, 16).count()
    kept = packing.pack(df, WORD, 16, keep_ids=True).collect()
    assert all(r.ids == want[r.doc_id][r.start : r.start + r.length] for r in kept)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_fits(counts):
    places = packing.plan(counts, 60)
    total, used = {}, {}
    for n, lo, hi, sequence, q, offset in places.tolist():
        assert lo == total.get(n, 0)
        total[n] = hi
        for r in range(hi - lo):
            used.setdefault(sequence + r // q, []).append((offset + r % q * n, n))
    assert total == counts
    for items in used.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 60 and sum(3 * n > 60 for _, n in items) <= 2
    # no two pieces longer than half a sequence share one
    low = max(-(-sum(n * c for n, c in counts.items()) // 60), sum(c for n, c in counts.items() if 2 * n > 60))
    assert len(used) <= 1.5 * low + 1


def test_op10_whole_table(spark):
    lengths = np.array([len(x) - 1 for x in expected_ids(spark, SF, BYTE, 0).values()])
    rows = QUERIES["op10_token_counts"](spark, SF).collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        assert (r.n_docs, r.docs_cut, r.docs_fit) == ((lengths == r.context_limit).sum(), (lengths > r.context_limit).sum(), (lengths <= r.context_limit).sum())
        assert r.tokens_kept == np.minimum(lengths, r.context_limit).sum() and r.tokens_fit == lengths[lengths <= r.context_limit].sum()


def test_op10_edges(spark):
    df = docs_of(spark, ODD)
    histogram = token_counts.length_histogram(df, BYTE)
    lengths = [len(Tokenizer.from_file(BYTE).encode(x or "", add_special_tokens=False).ids) for x in ODD]
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == {n: lengths.count(n) for n in lengths}
    table = token_counts.limit_table(histogram)
    assert token_counts.quantile(table, 0.5).first().n_tokens == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.truncated_total(histogram, [5]).first().kept_5 == sum(min(n, 5) for n in lengths)
    assert token_counts.token_counts(df.limit(0), BYTE).count() == 0
