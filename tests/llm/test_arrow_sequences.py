import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from cursus.llm import arrow_sequences, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def expected(rows):
    """doc_id -> (start, n_tokens, crc) by whole-text encoding, one document after the other."""
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.setdefault(doc_id, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return {k: sorted(v) for k, v in out.items()}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    return {k: sorted(v) for k, v in out.items()}


def test_query_equals_whole_text_encoding(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert got(queries.op10_arrow_sequences(spark, SF)) == expected(list(zip(t["doc_id"], t["text"])))


def test_blanks_nulls_ties_and_long_texts(make_docs):
    rows = [(3, " a  b \n c\t d \n\n  e"), (1, None), (2, ""), (2, "  "), (2, "x y"), (2, "x y"), (None, "null id"),
            (9, "don't  stop <|endoftext|>   café   \U0001f600 " * 3), (10, "word " * 30_000),
            (11, "a" * 50_000), (12, "1 2 3  4   5\r\n 6"), (13, "tab\t x \x0b y \x1c z")]
    assert got(arrow_sequences.read_documents(
        arrow_sequences.write_sequences(make_docs(rows), PATH, 2))) == expected(rows)


def test_sequences_are_equal_and_readable_at_random(make_docs, tmp_path):
    docs = make_docs([(k, f"text number {k} " * (k % 7)) for k in range(200)]).coalesce(1)
    index = arrow_sequences.write_sequences(docs, PATH, 2, folder=str(tmp_path / "out"), length=16, sequences=4)
    total = 0
    for file, n in {(r["file"], r["n"]) for r in index.groupBy("file").agg({"n_tokens": "sum"}).withColumnRenamed(
            "sum(n_tokens)", "n").collect()}:
        reader = arrow_sequences.SequenceReader(file)
        rows = sum(reader.file.get_batch(k).num_rows for k in range(reader.file.num_record_batches))
        assert rows == -(-n // 16)
        pairs = [reader.sequence(k) for k in range(rows)]
        assert all(len(ids) == 16 for ids, _ in pairs)
        assert not pairs[0][0].flags.owndata
        # a mask's buffer is the batch's, in the map
        whole = reader.file.get_batch(1).column(1).flatten().buffers()[1]
        assert rows < 6 or reader.sequence(5)[1].buffers()[1].address == whole.address
        assert [x for _, mask in pairs for x in mask.to_pylist()] == [k < n for k in range(16 * rows)]
        flat = np.concatenate([ids for ids, _ in pairs])
        assert (np.concatenate(reader.run(5, n - 9)) == flat[5:n - 4]).all()
        total += n
    assert total == index.agg({"n_tokens": "sum"}).first()[0]


def test_empty_table_and_extra_columns(make_docs):
    empty = make_docs([]).withColumnRenamed("lang", "start").withColumnRenamed("source", "ids")
    assert arrow_sequences.read_documents(arrow_sequences.write_sequences(empty, PATH, 2)).count() == 0
    docs = make_docs([(1, "a b")]).withColumnRenamed("lang", "file").withColumnRenamed("source", "part")
    assert arrow_sequences.read_documents(arrow_sequences.write_sequences(docs, PATH, 2)).count() == 1
