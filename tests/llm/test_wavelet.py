import zlib

import numpy as np
import public_tokenizers
import pytest

from settlespark.llm.encoding import _tokenizer
from settlespark.llm.wavelet import Shard, WaveletMatrix, open_shard, token_files, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n, sigma", [(0, 1), (1, 1), (7, 1), (64, 2), (1000, 3), (5000, 700), (4097, 4000)])
def test_matrix_answers_like_the_plain_sequence(n, sigma):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % sigma * 7).astype(np.uint32)
    shard = Shard.from_bytes(Shard(WaveletMatrix.build(ids), [1], np.array([n])).to_bytes())
    m = shard.matrix
    assert (m.decode() == ids).all()
    if n:
        assert (m.access(np.arange(n)) == ids).all()
    for id_ in [*ids[:5].tolist(), 3]:
        where = np.flatnonzero(ids == id_)
        assert (m.occurrences(id_) == where).all()
        assert m.count(id_, n // 3, n) == (where >= n // 3).sum()
        assert m.select(id_, len(where))[0] == -1
        assert (m.rank(id_, [0, n // 2, n]) == [(where < x).sum() for x in (0, n // 2, n)]).all()


def test_files_hold_every_document(spark, tmp_path):
    rows = [(3, "hello world"), (1, ""), (2, None), (5, "the 'll  \n it's 42 " * 3000), (None, "x"),
            (3, "again"), (-4, "naïve É")] + [(i, f"word {i} " * (i % 9)) for i in range(100, 300)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, id int")
    tokenizer = _tokenizer(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, at = [], 0
    for id_, text in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((id_, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files(df, PATH, 2, shard_tokens=500)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    files = write_shards(df, f"file://{tmp_path}/out", PATH, 2, shard_tokens=500).collect()
    assert len(files) > 3 and sum(f.n_tokens for f in files) == at
    assert open_shard(files[0].path).matrix.length == files[0].n_tokens


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []
