import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from cursus.llm import gumbel_pieces as gp
from cursus.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v():
    return gp.vocabulary(PATH)


def segmentations(v, text):
    """ids -> log probability of all segmentations, by trying every piece at every place."""
    ids = {b: i for i, b in reversed(list(enumerate(v.bytes))) if v.weight[i]}
    data = (" " + text).encode() if text else b""
    out = {}

    def walk(at, taken, weight):
        if at == len(data):
            out[tuple(taken)] = weight
            return
        width = len(data[at:].decode()[0].encode())
        for n in range(1, v.longest + 1):
            if data[at:at + n] in ids and at + n <= len(data):
                walk(at + n, [*taken, ids[data[at:at + n]]], weight + v.weight[ids[data[at:at + n]]])
        if data[at:at + width] not in ids:
            walk(at + width, taken + [int(v.byte_ids[b]) for b in data[at:at + width]], weight + gp.BYTE * width)

    walk(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: w - total for k, w in out.items()}


def sample(v, texts, k, first_key=0):
    out = [[] for _ in texts]
    keys = gp.textkit.mix(np.arange(first_key + 1, first_key + 1 + len(texts)).astype(np.uint64)).view(np.int64)
    for i, rank, path, threshold, b in gp.sample_batch(v, pa.array(texts, pa.string()), keys, k):
        assert rank == len(out[i]) + 1
        out[i].append((tuple(gp.piece_ids(v, b.lattice, path.edges)[0].tolist()), path, threshold))
    return out


@pytest.mark.parametrize("text", ["the cat", "a\nb", " x ", "\n\n", "é\U0001f600", "a▁b", "  two", "tab\tx"])
def test_probabilities_and_all_segmentations(v, text):
    want = segmentations(v, text)
    [got] = sample(v, [text], len(want) + 5)
    assert {ids for ids, _, _ in got} == set(want) and len(got) == len(want)
    for ids, path, threshold in got:
        assert path.log_prob == pytest.approx(want[ids], abs=1e-9)
        assert v.decode(np.array(ids)) == text.encode()
        assert threshold == -np.inf
    scores = [path.score for _, path, _ in got]
    assert scores == sorted(scores, reverse=True)


def test_samples_are_drawn_without_replacement_by_probability(v):
    text, n = "on it", 6_000
    want = segmentations(v, text)
    first, second, weighted = Counter(), Counter(), []
    for lo in range(0, n, 1_000):
        for got in sample(v, [text] * 1_000, 2, lo):
            (a, pa_, threshold), (b, pb, _) = got
            assert a != b and pa_.score >= pb.score >= threshold
            first[a] += 1
            second[b] += 1
            weighted.append(sum(np.exp(p.log_prob - gp._log_inclusion(p.log_prob, threshold)) for p in (pa_, pb)))
    p = {k: np.exp(w) for k, w in want.items()}
    for k in sorted(p, key=p.get)[-6:]:
        later = sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)
        for count, share in ((first[k], p[k]), (second[k], later)):
            assert abs(count - n * share) < 5 * np.sqrt(n * share * (1 - share)) + 1
    assert abs(np.mean(weighted) - 1) < 0.05  # the inclusion scores make sums unbiased


def test_tails_are_split_when_they_are_popped(v, monkeypatch):
    monkeypatch.setattr(gp, "AHEAD", 1)
    want = segmentations(v, "on it")
    [got] = sample(v, ["on it"], len(want) + 1)
    assert len(got) == len(want) and {ids for ids, _, _ in got} == set(want)
    first = Counter(g[0][0] for lo in range(3) for g in sample(v, ["on it"] * 1_000, 1, lo * 1_000))
    for k, w in sorted(want.items(), key=lambda x: x[1])[-4:]:
        assert abs(first[k] - 3_000 * np.exp(w)) < 5 * np.sqrt(3_000 * np.exp(w))


def test_query_restores_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = queries.op3_gumbel_pieces(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: gp.K for i, x in zip(t["doc_id"], t["text"]) if x})
    assert all(r.restored and r.log_inclusion <= 0 for r in rows)
    again = {(r.doc_id, r["sample"]): r.ids_crc32 for r in queries.op3_gumbel_pieces(spark, SF).repartition(3).collect()}
    assert again == {(r.doc_id, r["sample"]): r.ids_crc32 for r in rows}


def test_edge_texts(make_docs):
    rows = [(1, None), (2, ""), (3, " "), (4, "word " * 30_000), (5, "x" * 20_000), (6, "same"), (6, "same"), (None, "no id"),
            (7, "\n" * 50), (8, "Á́ ▁▁ \u0000 \U0001f600")]
    docs = make_docs(rows).withColumnRenamed("lang", "sample").withColumnRenamed("source", "ids")
    got = gp.sample_pieces(docs, PATH).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = dict(rows)
    for r in got:
        assert r.restored and r.n_ids == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if texts[r.doc_id] and "\u0000" not in texts[r.doc_id]:
            assert model.decode(list(r.ids)) == texts[r.doc_id]
    by_id = Counter(r.doc_id for r in got)
    assert by_id[1] == by_id[2] == 1 and by_id[4] == 2 and by_id[6] == 4
    assert len({tuple(r.ids) for r in got if r.doc_id == 6}) == 2
    assert gp.sample_pieces(make_docs([]), PATH).count() == 0
