"""Packing: every token counts, and captions are dealt to shards by what they hold."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_of_most_captions_count():
    """BM25 by its formula over all terms, most of them in more than a fifth of the captions, some captions equal."""
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 30, size=rng.integers(1, 40)).astype(np.uint16) for _ in range(60)]
    ids += [ids[0]] * 30 + [ids[1]]
    n, mean = len(ids), float(np.mean([len(i) for i in ids]))
    frequencies = np.zeros(40)
    for i in ids:
        frequencies[np.unique(i)] += 1
    assert (frequencies > 0.2 * n).sum() > 10
    index = packing.Bm25Shard(ids, frequencies, n, mean)
    for seed in range(n):
        want = np.zeros(n)
        for t in np.unique(ids[seed]):
            idf = np.log(1 + (n - frequencies[t] + 0.5) / (frequencies[t] + 0.5))
            for d in range(n):
                tf = (ids[d] == t).sum()
                want[d] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean))
        np.testing.assert_allclose(index.scores(seed), want, atol=1e-9)
        assert (index.scores(seed) > 0).any()


def test_two_captions_with_the_same_tokens_find_each_other():
    ids = [np.array([1, 2, 0]), np.array([3, 0]), np.array([1, 2, 0])]
    index = packing.Bm25Shard(ids, np.array([3.0, 2, 2, 1]), 3, 8 / 3)
    assert index.scores(0)[2] == index.scores(0)[0] > index.scores(0)[1]


def test_copies_meet_in_a_shard(spark):
    """Copies lie far from each other in the input, and one of the texts has more copies than a shard takes."""
    r = random.Random(2)
    base = [" ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.choice('nrst')}{r.randint(0, 99)}" for _ in range(40)) for _ in range(60)]
    texts = base * 3 + [base[7]] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, caption string").repartition(5, "item_id")
    pieces = packing.pack_captions(df, BPE, window=256, shard_tokens=2000).toPandas()
    pieces["shard"] = pieces.sequence_id // packing.SEQUENCE
    shards = pieces.groupby("item_id").shard.min()
    tokens = pieces.groupby("shard").length.sum()
    assert len(tokens) > 8 and tokens.max() < 2 * 2000
    together = sum(len({shards[k + 60 * i] for i in range(3)}) == 1 for k in range(60) if k != 7)
    # a group may lie over the end of a shard
    assert together >= 59 - len(tokens)
    group = [7, 67, 127, *range(180, 280)]
    size = pieces[pieces.item_id.isin(group)].length.sum()
    assert shards[group].nunique() <= -(-size // 2000) + 1


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "b" + "\n" * 1_200_000, "a" + " \n" * 600_000 + "<|endoftext|>", "xy" * 400_000])
def test_very_long_runs_are_encoded_as_by_tokenizers(text):
    want = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids + [packing.END]
    assert packing.encode(packing.encoder(BPE), text).tolist() == want


def test_keys_of_a_batch_follow_the_tree_and_the_rarest_tokens():
    r = np.random.default_rng(3)
    sample = [r.integers(0, 500, size=r.integers(1, 80)) for _ in range(200)]
    dealer = packing.Dealer(sample, 500)
    found = [np.unique(r.integers(0, 500, size=r.integers(1, 80)), return_counts=True) for _ in range(300)]
    for key, (terms, counts) in zip(dealer.keys(found).tolist(), found, strict=True):
        vector, node = dealer.vector(terms, counts), 0
        while node < len(dealer.middles):
            node = 2 * node + 1 + int(dealer.normals[node] @ vector > dealer.middles[node])
        want = node - len(dealer.middles)
        last = (1 << packing.KEY_BITS) - 1
        for rank in (sorted(dealer.ranks[terms].tolist()) + [last] * packing.KEY_TOKENS)[: packing.KEY_TOKENS]:
            want = want << packing.KEY_BITS | rank
        assert key == want
    assert len(dealer.keys([])) == 0
