import numpy as np
import pyarrow as pa

from textmill.llm import ngram_join


def test_groups_that_agree_in_their_upper_bits_are_two(monkeypatch):
    shared = np.uint64(1 << 60)
    sets = [np.array([np.uint64(7 << 32 | low), shared], np.uint64) for low in (1, 3)]
    monkeypatch.setattr(ngram_join, "_texts", lambda table: (table.column("text").to_pylist(), None, None))
    monkeypatch.setattr(ngram_join, "token_sets", lambda texts, size: iter([sets[int(t)] for t in texts]))

    def levels(*blocks):
        asked = [ngram_join._ask(1, 5)(pa.table({"block": pa.array([i] * len(b), pa.int32()), "text": b})) for i, b in enumerate(blocks)]
        return np.frombuffer(b"".join(ngram_join._tell(pa.concat_tables(asked)).column("levels").to_pylist()), np.uint8)

    assert (levels(["0", "1"]) > ngram_join.SINGLE).all()  # a token is sent once from each block
    assert len(levels(["0"], ["1"])) == 2 and (levels(["0"], ["1"]) > ngram_join.SINGLE).all()
    assert (levels(["0"], ["0"]) == ngram_join.SINGLE).all()


def test_many_groups_on_one_token_form_no_pairs():
    """Two thousand texts, each a group of its own, chose one token: each visits one cell, and linked ones are done."""
    n = 2000
    ids = np.arange(n, dtype=np.int64)
    chosen = pa.table({"block": pa.array([0], pa.int32()), "ids": [ids.tobytes()], "tokens": [np.full(n, 4, np.uint64).tobytes()]})

    def state(classes):
        return pa.table({"id": ids, "cell": ids + 10, "class": classes, "n": np.full(n, 30), "shared": np.full(n, 30)})

    def choices(classes, last):
        offers = ngram_join._offer(1)(chosen, state(classes))
        kind = offers.column("kind").to_pylist()
        hubs = ngram_join._hub(offers.take([kind.index(ngram_join.SUMMARY)]))
        return ngram_join._choose(1, last)(offers.take([kind.index(ngram_join.KEPT)]), hubs)

    assert choices(ids, False).column("kind").to_pylist() == [ngram_join.VISIT] * (n - 1) + [ngram_join.LEFT]
    assert choices(np.zeros(n, np.int64), False).num_rows == 0
    two = choices((ids == 7).astype(np.int64), True)
    visits = ngram_join._pairs(two)
    assert visits.num_rows == n - 1 and set(visits.column("home").to_pylist()[:7]) == {17}


def test_texts_that_share_too_little_do_not_meet():
    row = {"tokens": np.full(3, 4, np.uint64), "ids": np.arange(3), "cells": np.arange(3) + 10, "classes": np.arange(3), "sizes": np.full(3, 100, np.uint32), "shared": np.array([85, 86, 87], np.uint32)}
    assert ngram_join._pairs(pa.table({k: [v.tobytes()] for k, v in row.items()})).to_pylist() == [{"id": 1, "home": 12}]
