import functools
import zlib

import numpy as np
import public_tokenizers
from cases import docs, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(path, text, end):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_segments_keep_ids(spark, sf):
    import pyarrow as pa

    from tidemark.llm._ids import Encoder

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += [None, "", " ", "a  b\n c \n", "x  y　 z  w", "it's  <|endoftext|> don't", "a <|endoftext|> b", "a  <|endoftext|>  b", "x<|endoftext|>y<|endoftext|><|startoftext|>z", "<|endoftext|>", "\n<|endoftext|>\n\n<|startoftext|> \n", "<|ENDOFTEXT|> <|endof text|>", "é<|endoftext|>é", "a\t\tb\x0b c", "é à  b", "́ x", "ΣΑΣ Σ", " \n\n x", "İI", "…  x", "ÿ  y", "\x1c x \x1f\n y"]
    for path, joins in ((BYTES, True), (WORDS, False)):
        ids, at = Encoder(path, joins).encode(pa.array(texts), 9)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(path, t, 9) for t in texts]


def test_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = docs(spark)
    token_files.write(df, path, BYTES, shards=3)
    got = token_files.read(spark, path).orderBy("start").collect()
    want, at = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")), 0
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for g, w in zip(got, want):
        assert g.start == at and g.tokens == ids_of(BYTES, w.text, 0) and g.n_tokens == len(g.tokens)
        at += g.n_tokens
    plan = token_files.read(spark, path, tokens=False).where("doc_id = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)" in plan and ":array" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_token_file_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/e"
    token_files.write(docs(spark), path, BYTES, shards=1)
    (name,) = glob.glob(f"{tmp_path}/e/tokens/*.parquet")
    group = pq.ParquetFile(name).metadata.row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and "DELTA_BINARY_PACKED" in kinds["local_start"].encodings
    assert any("DICTIONARY" in e for e in kinds["tokens.list.element"].encodings)
    assert all(c.has_offset_index and c.has_column_index for c in kinds.values())


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(empty(spark), f"file://{tmp_path}/n", BYTES)
    assert token_files.read(spark, f"file://{tmp_path}/n").count() == 0


def test_query_2(spark, sf):
    got = {r.doc_id: r for r in token_files.op2_token_files(spark, sf).collect()}
    rows, at = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), 0
    assert len(got) == len(rows)
    for r in rows:
        ids = ids_of(BYTES, r.text, 0)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def check_packed(pieces, texts):
    """Every id in one piece; sequences gapless from 0, of power-of-two length, at most 4096."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    for doc_id, text in texts:
        ids, at = ids_of(WORDS, text, 2), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)


def test_packing(spark, sf):
    for n in (1, 3):
        rows = [(i, r.text, "x", "y") for i, r in enumerate(docs(spark).collect())]
        check_packed(packing.digests(packing.pack(docs(spark, rows).repartition(n), WORDS)).collect(), [r[:2] for r in rows])
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check_packed(packing.op8_harmonic_packing(spark, sf).collect(), rows)


def test_packing_repeats_and_nothing(spark):
    got = packing.pack(docs(spark), WORDS)
    twice = got.where("doc_id = 3").groupBy("start").count().collect()
    assert {r["count"] for r in twice} == {2}
    assert got.where("doc_id is null").agg(F.sum("length")).first()[0] == sum(len(ids_of(WORDS, t, 2)) for t in ("null id here", None))
    assert packing.pack(empty(spark), WORDS).count() == 0


HARD = ["a", "B", "s", "'", "'s", "'T", "'Re", "ll", "é", "É", "ß", "Ÿ", "×", "÷", "ª", "µ", "\u0301", "\u0331", "\u0307", "\u030c", "j", "J", "H", "W", "I", "İ", "Σ", "0", "12", "٣", "²", ",", "-", "!", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "endoftext", "=", "\u0338", "\x7f", "\x1c", "\x85", "\u3000", "\xa0", " ", " ", "\n", "漢", "ᄀ", "ᅡ", "\u212a", "😀", "\u200d", "Ü", "\u0304", "The", "don't", "\u09c7", "\u09be", "\x00"]


def test_cut_and_folded_words_keep_ids(monkeypatch):
    """Random strings of what cuts inside words, case folding and the direct way to the model could get wrong."""
    import random

    import pyarrow as pa

    from tidemark.llm import _ids

    for keep in (_ids.KEEP, 50):
        monkeypatch.setattr(_ids, "KEEP", keep)
        draw, table = random.Random(keep), _ids.Encoder(WORDS, False)
        for k in range(16):
            texts = ["".join(draw.choices(HARD, k=draw.randint(0, 12))) for _ in range(250)] + [None, "", "The", "The"]
            texts = [t and t.replace("<|", "<") for t in texts] if k % 2 else texts  # without a special token letters are folded
            ids, at = table.encode(pa.array(texts), 9)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(WORDS, t, 9) for t in texts]


class Counting:
    """A tokenizer, or its model, that keeps what it is asked to encode."""

    def __init__(self, inner, asked):
        self.inner, self.asked = inner, asked

    def __getattr__(self, name):
        return Counting(self.inner.model, self.asked) if name == "model" else getattr(self.inner, name)

    def encode_batch_fast(self, texts, **how):
        self.asked += texts
        return self.inner.encode_batch_fast(texts, **how)

    def tokenize(self, word):
        self.asked.append(word)
        return self.inner.tokenize(word)


def test_full_table_keeps_frequent_words(monkeypatch):
    """New words without end fill the table again and again; words of all blocks are still encoded once, not once a filling."""
    import pyarrow as pa

    from tidemark.llm import _ids

    monkeypatch.setattr(_ids, "KEEP", 400)
    table, asked = _ids.Encoder(WORDS, False), []
    table.tokenizer = Counting(table.tokenizer, asked)
    letters = "abcdefghij"
    for k in range(60):
        new = " ".join("z" + "".join(letters[int(c)] for c in f"{k * 50 + i:06}") for i in range(50))
        ids, _ = table.encode(pa.array([f"often {new} always, 12"]), 9)
        assert ids.tolist() == ids_of(WORDS, f"often {new} always, 12", 9)
    assert len(table.keys) <= 400 and len(asked) >= 3000
    assert asked.count("often") == 1 and sum("always" in x for x in asked) == 1


def test_one_way_through_a_worker(spark, sf):
    """Cutting and summing ids is one pass of one worker, with the rows of digests(pack())."""
    rows = [(i, r.text, "x", "y") for i, r in enumerate(docs(spark).collect())]
    df = docs(spark, rows).coalesce(1)
    got, want = packing.pack_digests(df, WORDS), packing.digests(packing.pack(df, WORDS))
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
    assert packing.op8_harmonic_packing(spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
