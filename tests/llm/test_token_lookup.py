"""Wavelet files: access, counting and lookup without decoding, and over Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from riskweave.llm import token_files, wavelet
from tests.llm import corpora


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 5000, 600_000])
def test_lookups_equal_plain_search(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.geometric(0.002, size), 65_535).astype(np.uint16)
    data = wavelet.WaveletMatrix.build(ids, 16).to_bytes()
    stored = wavelet.WaveletMatrix.from_bytes(data)
    assert all(not p.unpacked for p in stored.planes)
    for place in rng.integers(0, size, 20).tolist() if size else []:
        assert stored.access(place) == ids[place]
    if size == 600_000:  # an access unpacks a block or two per plane, not the file
        one = wavelet.WaveletMatrix.from_bytes(data)
        assert one.access(300_000) == ids[300_000] and sum(len(p.unpacked) for p in one.planes) <= 2 * 16 < sum(len(p.ends) for p in one.planes)
    for token in [1, 2, 50, 3000, 65_535, 70_000, *(ids[:3].tolist())]:
        assert stored.count(token) == (ids == token).sum()
        assert stored.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        a, b = sorted(rng.integers(0, size + 1, 2).tolist())
        assert stored.count(token, a, b) == (ids[a:b] == token).sum()
    assert (stored.decode() == ids).all()


def test_tokens_are_found_in_the_written_files(spark, tmp_path):
    data = [r for r in corpora.rows() if r[0] is not None]
    path = str(tmp_path / "files")
    token_files.write_token_files(corpora.frame(spark, data), path, shard_ids=2_000)
    coder = token_files.library(token_files.public_tokenizers.path("byte_bpe_50k.json"))
    encoded = [(r[0], coder.encode(r[1] or "", add_special_tokens=False).ids + [token_files.END_ID]) for r in data]
    totals = Counter(x for _, ids in encoded for x in ids)
    for token in [token_files.END_ID, totals.most_common(3)[-1][0], min(totals, key=totals.get), 49_999]:
        found = Counter((r["doc_id"], r["place"]) for r in token_files.find_token(spark, path, token).collect())
        assert found == Counter((doc_id, place) for doc_id, ids in encoded for place, x in enumerate(ids) if x == token)
        counts = token_files.count_token(spark, path, token)
        assert counts.count() > 1 and sum(r["n"] for r in counts.collect()) == totals[token]
