"""The divergence audit against SQL and a brute-force version over all terms."""

import re
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import divergence_audit, queries
from tests.llm.helpers import ODD, SF, empty, odd
from tests.oracle import connect, rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(table, least):
    """All shares of all terms, pair by pair: rows (lang, source, part, item, value, rank) of (lang, source, text) rows."""
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in table:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, docs in in_docs.items():
        kept = [t for t, n in docs.items() if n >= least]
        own = {s: c for (of, s), c in groups.items() if of == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def test_query(spark):
    got = queries.op11_divergence_audit(spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).execute(queries.ORACLES["op11_divergence_audit"]).df())


@pytest.mark.parametrize("least", [1, 2, 100])
def test_against_brute_force(spark, monkeypatch, least):
    """Odd rows and clashing columns; with 100, no term is kept and pairs have the value 0."""
    monkeypatch.setattr(divergence_audit, "LEAST_DOCS", least)
    table = odd(spark).selectExpr("*", "1 as term", "'x' as part", "2 as n", "3 as zero").repartition(3)
    got = sorted(tuple(r) for r in divergence_audit.audit(table).collect())
    assert got == brute([(r[2], r[3], r[1]) for r in ODD], least)
    assert least < 100 or {r[4] for r in got} == {0}
    assert divergence_audit.audit(empty(spark)).collect() == []


def test_ties_and_flushes(spark, monkeypatch):
    """Many sources with equal counts, more terms than a task counts at once, and a source with a third of all rows."""
    monkeypatch.setattr(divergence_audit, "LEAST_DOCS", 1)
    monkeypatch.setattr(divergence_audit, "ROOM", 7)
    table = [("en", "hot" if k % 3 == 0 else f"s{k % 7}", f"Wort{k % 5} wort{k % 11}x é É ß{k % 2}") for k in range(120)]
    got = sorted(tuple(r) for r in divergence_audit.audit(spark.createDataFrame(table, "lang string, source string, text string")).collect())
    assert got == brute(table, 1)


def test_long_texts_in_slices(monkeypatch):
    whole = "Äb9cd " * 50 + "x" * 40 + " " + "y" * 7
    want = [t.encode() for t in TERM.findall(whole.translate(LOWER))]
    for size in (1, 3, 16, 1000):
        monkeypatch.setattr(divergence_audit, "SLICE", size)
        assert [w for part in divergence_audit.words(whole) for w in part] == want
