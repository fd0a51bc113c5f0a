import re
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    """rows: (lang, source, text)"""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(UPPER))
        groups[lang].add(source)
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        shares = {}
        for of in [*sources, None]:
            own = {t: sum(count[lang, s][t] for s in (sources if of is None else [of])) for t in kept}
            total = sum(own.values())
            shares[of] = {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}
        for s in sources:
            price = lambda p, q: (p - q) * (p - q) // q
            pairs = [(sum(price(shares[s][t], shares[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(price(shares[s][t], shares[None][t]), t) for t in kept if count[lang, s][t] and shares[s][t] > shares[None][t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_matches_brute_force(spark, documents):
    rows = [(lang, source, text) for _, text, lang, source in documents]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    want = brute(rows)
    assert result(divergence.audit(frame)) == want
    assert result(divergence.audit(frame, block_rows=500)) == want  # many blocks give the same tables


def test_few_terms_and_odd_rows(spark, nasty):
    rows = [tuple(r) for r in nasty.select("lang", "source", "text").collect()] * 2
    frame = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr(
        "*", "1 AS n", "2 AS total", "3 AS kept", "4 AS block", "'z' AS term", "5 AS rank")
    for least, top in ((3, 200), (1, 2), (100, 5)):  # the last keeps no term: pairs of value 0
        assert result(divergence.audit(frame, least, top)) == brute(rows, least, top)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_a_hot_source_and_equal_values(spark):
    rows = [("en", "big", "a b c d a")] * 300 + [("en", "s", "a b"), ("en", "t", "a b"), ("en", None, None), ("de", "x", "a b c")] * 3
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(divergence.audit(frame)) == brute(rows)


def test_tiles_give_the_whole_product():
    rng = np.random.default_rng(5)
    cells = np.unique(rng.integers(0, 60, (4000, 2)), axis=0)  # (source % 6, term)
    cells = np.unique(np.stack([cells[:, 0] % 6, cells[:, 1]], 1), axis=0)
    n = rng.zipf(1.5, len(cells)).clip(1, 50)
    wide, narrow = (divergence.level_products(cells[:, 0], cells[:, 1], n, tile) for tile in (10**9, 3))
    assert all((a == b).all() for a, b in zip(wide, narrow))
    want = Counter()
    by = defaultdict(dict)
    for (s, t), k in zip(cells.tolist(), n.tolist()):
        by[t][s] = k
    for levels in by.values():
        want.update((a, levels[a], b, levels[b]) for a in levels for b in levels if a <= b)
    assert Counter(dict(zip(zip(*(x.tolist() for x in wide[:4])), wide[4].tolist()))) == want
