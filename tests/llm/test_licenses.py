import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)
GRANT = dict(reversed(licenses.NOTICES))["mit"]


def plain(text):
    return WORDS.findall((text or "").translate(LOWER))


def scan(text):
    """Every template tried at every word of the text, without hashes, votes or joins."""
    words, places, labels, best = plain(text), [], set(), 0.0
    base = set()
    for n, (label, phrase) in enumerate(licenses.PHRASES + licenses.NOTICES):
        t = plain(phrase)
        k = min(licenses.K, len(t))
        hits = {}
        for p in range(len(words) - k + 1):
            for q in range(len(t) - k + 1):
                if words[p:p + k] == t[q:q + k]:
                    hits.setdefault(p - q, set()).add(q)
        if n < len(licenses.PHRASES):
            places += hits
            base |= {label} if hits else set()
            best = max(best, 1.0 if hits else 0.0)
            labels |= {label} if hits else set()
            continue
        copies, last = [], None
        for d in sorted(hits):
            if last is None or d - last > licenses.DRIFT:
                copies.append(set())
            copies[-1] |= {q + i for q in hits[d] for i in range(k)}
            last = d
        for covered in copies:
            if len(covered) * 100 >= len(t) * licenses.SHARE:
                labels.add(label)
                best = max(best, len(covered) / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), best)


def got(make, rows):
    return [tuple(r) for r in licenses.license_scan(make(rows)).collect()]


def key(row):
    return tuple((v is not None, v) for v in row)


def test_licenses(make, odd):
    broken = GRANT.split()
    broken[10], broken[20:22] = "changed", []
    rows = odd + [
        (20, "MIT LICENSE mit license, mit-license"), (21, f"x {GRANT} y"), (22, " ".join(broken)), (23, "mit"),
        (24, "the GNU General Public License; the Apache License"), (25, f"{GRANT} {GRANT} Licensed under CC BY-NC 4.0"),
        (26, " ".join(broken[:9])), (27, "mït license \x1cApache\x00License Kit"), (28, GRANT[:150]), (28, GRANT[:150]), (None, "MIT license"),
        (29, ("w " * 1022 + "mit license " + "w " * 1020 + GRANT) * 3),
    ]
    assert sorted(got(make, rows), key=key) == sorted([(r[0], *scan(r[1])) for r in rows], key=key)
    assert got(make, []) == []


def test_other_notices(make):
    with pytest.raises(ValueError):
        licenses.license_scan(make([(1, "x")]), [("one", "word")])
    own = licenses.license_scan(make([(1, "free as in speech, not beer")]), [("own", "Free as in speech")]).first()
    assert own.labels == "own" and own.score == 1.0 and own.n_base == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(plain(GRANT)[:9] + ["mit", "license", "apache", "cc", "by", "nc", "4", "0", "licensed", "under"]), max_size=60), min_size=20, max_size=40))
def test_any_words(make, texts):
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    assert sorted(got(make, rows), key=key) == sorted([(r[0], *scan(r[1])) for r in rows], key=key)
