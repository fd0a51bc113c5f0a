import hashlib

import numpy as np
import pytest

from plumbline.llm import queries, sharding
from tests.llm.conftest import FOLDER


def brute_table(shards, size):
    """Turns taken one claim at a time over whole permutations."""
    number = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    order = []
    for s in shards:
        at, skip = number(s, "offset") % size, number(s, "skip") % (size - 1) + 1
        order.append(iter([(at + k * skip) % size for k in range(size)]))
    table, names = {}, list(shards)
    while len(table) < size:
        for k, s in enumerate(names):
            for _ in range(shards[s]):
                if len(table) < size:
                    table[next(slot for slot in order[k] if slot not in table)] = k
    return [table[i] for i in range(size)]


def slot(key, size=sharding.TABLE_SIZE):
    text = "null" if key is None else f"={key}"
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % size


def test_table_matches_brute_force():
    shards = {"a": 1, "b": 3, "c": 1}
    assert sharding.lookup_table(shards, 251).tolist() == brute_table(shards, 251)


def test_shares_are_even_and_few_keys_move():
    names = [f"s{i}" for i in range(50)]
    table = sharding.lookup_table(names)
    shares = np.bincount(table)
    assert shares.max() - shares.min() <= 2
    fewer = sharding.lookup_table(names[:-1])
    moved = np.mean((table != fewer) & (table < 49))
    assert moved < 0.05


def test_query_matches_brute_force(spark, documents):
    table, names = brute_table(queries.SHARDS, sharding.TABLE_SIZE), list(queries.SHARDS)
    rows = queries.op1_sharding(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in documents)
    assert all(r.slot == slot(r.doc_id) and r.shard == names[table[r.slot]] for r in rows)


def test_odd_rows(spark, nasty):
    named = nasty.withColumnsRenamed({"size": "slot", "code": "Shard"})
    rows = sharding.assign(named, "text", ["x", "y", "z"]).collect()
    assert len(rows) == nasty.count() and {"text", "lang", "slot", "shard"} <= set(rows[0].asDict())
    assert all(r.slot == slot(r.text) for r in rows)
    assert len({r.shard for r in rows if r.text is None}) == 1
    assert sharding.assign(nasty.limit(0), "text", ["x"]).count() == 0


@pytest.mark.parametrize("shards,size", [([], 101), (["a", "a"], 101), ({"a": 0}, 101), (["a"], 100), (["a"] , 10**9 + 7)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)
