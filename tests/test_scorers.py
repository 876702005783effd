"""The scorers of names against their rules in plain Python, every query against every app."""

from __future__ import annotations

import math
import re

import pytest
from lodestar.functions import text as X
from lodestar.operators import retrieve as R
from lodestar.plans import queries, roles
from pyspark.sql import functions as F

APPS = [
    (1, "地图", "di tu", "maps", "dt", "travel", 50), (2, "Mail Box", "mail box", "mail box", "mb", "office", 0), (3, "Map Maker", "map maker", "map maker", "mm", "travel", 3), (4, "Notes", "bi ji", "notes", "bj", "office", 100),
    (5, "Photo Note", "xiang ji", "photo", "xj", "media", 0), (6, "微信 WeChat", "wei xin", "wechat", "wx", "media", 7), (7, "", "", "", "", "", 0), (8, "Notes", "bi ji", "notes", "bj", "office", 2), (9, "x" * 80, "", "", "", None, 1),
]
KIND = "app_id long, name string, py string, en string, abbr string, cat string, uses long"
ASKED = ["notes", "note", "ote", "ditu", "dit", "mb", "nts", "x", "n", "setno", "mpa", "maker map", "nites", "notse", "mial box", "paml", "wx", "xw", "微", "信微", "微x", "wecaht", "xiangji", "iang", "66837", "668", "93", "travel", "off", "xj", "qqqq", "e" * 40, "notesnotesnotesnotesnotesnotesnotes", "2", "abcdefgh", "tdui"]
TERMS = [("travel", "travel", "label"), ("tr", "travel", "initials"), ("trip", "travel", "keyword"), ("voyage", "travel", "root"), ("office", "office", "label"), ("off", "office", "root"), ("work", "office", "keyword"), ("qq", "media", "root"), ("media", "Media", "label")]


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame(APPS, KIND)


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, category string, kind string")


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")


def whole(x):
    return math.floor(round(x, 4))


def forms(a):
    _, name, py, en, abbr, cat, _ = a
    return (name or "").lower().strip(), re.sub(r"\s+", "", (py or "").lower()), (en or "").lower(), (abbr or "").lower(), (cat or "").lower()


def bigrams(a, b):
    x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def scramble(q, t, guard=4):
    if not q or not t or len(q) > guard * len(t):
        return 0
    if guard == 4 and len(q) > 32:
        return whole(220 * bigrams(q, t)) if bigrams(q, t) >= 0.4 else 0
    if any(c < "\x80" and c not in t for c in q):
        share = len(set(q) & set(t)) / len(set(q))
        return whole(0.6 * (whole(120 * share) if share >= 0.5 else 0))
    used, matched = [False] * len(t), 0
    for c in q:
        at = next((i for i in range(len(t)) if not used[i] and t[i] == c), None)
        if at is not None:
            used[at], matched = True, matched + 1
    if not matched:
        return 0
    r, cover = matched / len(q), matched / len(t)
    points = 250 * r * (1 + cover / 2) if r >= 0.9 else 200 * r * (1 + cover * 0.3) if r >= 0.7 else 150 * r if r >= 0.5 else 100 * r if r >= 0.3 else 80 * r
    return min(300, whole(points))


def scrambled(q, a, guard=4):
    return max(scramble(q, t, guard) for t in forms(a)[:4])


def categories(q):
    out = {}
    for t, cat, kind in TERMS:
        p = None
        if kind == "keyword":
            p = 100 if t == q else 90 if t.startswith(q) else 70 if q in t else None
        elif kind == "root":
            p = 94 if t == q else 82 if t.startswith(q) or q.startswith(t) else 66 if q in t or t in q else None
        elif kind == "label":
            p = 95 if t == q else 75 if q in t else None
        else:
            p = 85 if t == q else 80 if t.startswith(q) else None
        if p:
            out[cat.lower()] = max(p, out.get(cat.lower(), 0))
    return out


def ladder(q, a, guard=2):
    name, py, en, abbr, cat = forms(a)
    n = len(q)
    for ok, points in ((name == q, 1000), (name.startswith(q), 800 + 6 * n), (py == q, 600), (py.startswith(q), 500 + 5 * n), (abbr == q, 400), (abbr.startswith(q), 350 + 4 * n)):
        if ok:
            return points
    best = 150 + 5 * n if q in name else 120 + 4 * n if q in py else 0
    if best < 380 and en == q:
        best = 380
    elif best < 300 and en.startswith(q):
        best = 300 + 4 * n
    if best < 200 and cat in categories(q):
        best = max(best, 30, int(categories(q)[cat] * 0.5))
    if best < 150 and n >= 2:
        best = max(best, scrambled(q, a, guard))
    return best


def weighed(points, a):
    return min(1200, math.floor(points * (1 + 0.015 * min(a[6], 100)) + 1e-9)) if points else 0


def single(q, a):
    name, py, _, abbr, _ = forms(a)
    return 350 if abbr.startswith(q) else 300 if name.startswith(q) else 250 if py.startswith(q) else 150 if q in name else 120 if q in py else 0


def searched(q, k=30):
    rows = [(weighed(single(q, a) if len(q) == 1 else ladder(q, a), a), a[0]) for a in APPS]
    return sorted([(-s, i) for s, i in rows if s >= 25])[:k]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.app_id))
    return out


def test_ladder(spark, apps, terms):
    got = ranked(R.ladder_search(ask(spark, ASKED), apps, terms))
    for i, q in enumerate(ASKED):
        assert got.get(i, []) == searched(q), q


def distance(a, b):
    """Edits cost 2, substitutions by a touching key 1; an empty text is as far as the other is long."""
    if not a or not b:
        return len(a) + len(b)
    if len(a) > 64 or len(b) > 64:
        return plain_distance(a, b)
    if abs(len(a) - len(b)) > (len(a) + len(b)) // 2 + 2:
        return abs(len(a) - len(b))
    d = [list(range(len(b) + 1)), *([i, *[0] * len(b)] for i in range(1, len(a) + 1))]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 2, d[i][j - 1] + 2, d[i - 1][j - 1] + (0 if x == y else 1 if y in X.NEIGHBOURS.get(x, ()) else 2))
    return d[-1][-1]


def plain_distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    if abs(len(a) - len(b)) > (len(a) + len(b)) // 2 + 2:
        return abs(len(a) - len(b))
    d = [list(range(len(b) + 1)), *([i, *[0] * len(b)] for i in range(1, len(a) + 1))]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
    return d[-1][-1]


def near(q, t, base, most):
    d, limit = distance(q, t), max(len(q), len(t)) // 2 + 1
    return base + whole((1 - d / (limit + 1)) * most) if d <= limit else 0


def overlap(q, t):
    return len(set(q) & set(t)) / max(len(set(q)), len(set(t))) if q and t else 0.0


def contained(q, t):
    at, n = 0, 0
    for c in q:
        i = t.find(c, at)
        if i >= 0:
            at, n = i + 1, n + 1
    return n / len(q)


def typing(q, a):
    name, py, _, abbr, _ = forms(a)
    o, c = overlap(q, name), contained(q, name)
    return max(near(q, name, 100, 120), near(q, py, 90, 100), near(q, abbr, 80, 90), whole(o * 100) if o >= 0.5 else 0, whole(c * 90) if c >= 0.5 else 0)


def combined(q, a):
    name, py, _, abbr, _ = forms(a)
    d, most, n, score = plain_distance(q, py), max(len(py) // 2, 3), 0, 0.0
    jac = len(set(q) & set(abbr)) / len(set(q) | set(abbr)) if abbr else 0.0
    g, o, s = bigrams(q, py), overlap(q, name), scrambled(q, a)
    for ok, p in (
        (d <= most and d > 0 and overlap(q, py) >= 0.5, 120 + (1 - d / most) * 80), (g >= 0.35, 80 + g * 80), (len(q) >= 2 and len(abbr) >= 2 and jac >= 0.6, 60 + jac * 60), (o >= 0.4, 50 + o * 50), (s >= 50, s * 0.5),
    ):
        if ok:
            n, score = n + 1, score + p
    return whole(score) if n >= 2 else 0


def language(q, a):
    name, py, en, abbr, _ = forms(a)
    n, package = len(q), str(a[0])
    digits = re.sub("[^0-9]", "", name.translate({ord(c): "22233344455566677778889999"[i] for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}))
    english = max(near(q, en, 200, 150) if en else 0, 350 + 4 * n if en and en.startswith(q) else 0, 180 + 3 * n if en and q in en else 0, typing(q, a), 100 + 2 * n if q in package else 0)
    chinese = max(
        220 + 4 * n if q in name else 0, 380 + 5 * n if name.startswith(q) else 0, near(q, name, 200, 120), 280 + 4 * n if py.startswith(q) else 0, 180 + 3 * n if q in py else 0, 220 + 4 * n if abbr.startswith(q) else 0,
        320 if abbr == q else 0, combined(q, a), scrambled(q, a),
    )
    keypad = max(280 + 4 * n if q in digits else 0, 380 + 5 * n if digits.startswith(q) else 0, near(q, digits, 200, 120), near(q, en, 150, 100) if en else 0)
    han, latin = re.search("[一-鿿]", q), re.search("[a-z]", q)
    if re.fullmatch("[2-9]+", q):
        return keypad
    return max(english, chinese, keypad) if han and latin or not (han or latin) else chinese if han else english


def test_language(spark, apps):
    got = ranked(R.language_search(ask(spark, ASKED), apps))
    for i, q in enumerate(ASKED):
        assert got.get(i, []) == sorted((-s, a[0]) for a in APPS if (s := language(q, a)) >= 20), q


def variants(q):
    out = {q, re.sub(r"(.)\1+", r"\1", q)}
    side = lambda c: X.NEIGHBOURS.get(c, ())
    for i in range(len(q)):
        out |= {q[:i] + n + q[i + 1 :] for n in side(q[i])}
        if len(q) > 2:
            out.add(q[:i] + q[i + 1 :])
    for i in range(len(q) - 1):
        out |= {q[:i] + a + b + q[i + 2 :] for a in side(q[i]) for b in side(q[i + 1])}
        out.add(q[:i] + q[i + 1] + q[i] + q[i + 2 :])
    return out


def test_variants(spark):
    got = ask(spark, ASKED).select("q", R.variants(F.col("q")).alias("v")).collect()
    for r in got:
        assert len(r.v) == len(set(r.v)) and set(r.v) - {""} == variants(r.q) - {""}, r.q


def tolerant(q):
    near_ = variants(q)
    rows = []
    for a in APPS:
        s = max((w for v in near_ if v and (w := weighed(ladder(v, a, 4), a)) >= 20), default=0)
        t, m = typing(q, a), scrambled(q, a)
        s = max(s, t if t >= 20 else 0, m if m >= 30 else 0)
        if s:
            rows.append((-s, a[0]))
    return sorted(rows)


def test_tolerant_search(spark, apps, terms):
    some = [q for q in ASKED if len(q) < 9]
    got = ranked(R.tolerant_search(ask(spark, some), apps, terms))
    for i, q in enumerate(some):
        assert got.get(i, []) == tolerant(q), q


def parts(q):
    points = {}
    out, start = [], 0
    while start < len(q):
        best, end = 0, start + 1
        for e in range(min(start + 10, len(q)), start, -1):
            run = q[start:e]
            p = points.setdefault(run, max(weighed(ladder(run, a), a) for a in APPS))
            if p >= 200 and p > best:
                best, end = p, e
        out.append(q[start:end])
        start = end
    return out


def appended(q):
    runs = parts(q)
    if len(runs) <= 1:
        return [(i, None, -s) for s, i in searched(q)]
    first, rest = {}, {}
    for n, run in enumerate(runs):
        rows = sorted((-s, a[0]) for a in APPS if (s := weighed(ladder(run, a), a)) >= 25)[:5]
        for s, i in rows:
            if n == len(runs) - 1:
                first[i] = (n, 500 - s)
            elif i not in rest or -s > rest[i][1]:
                rest[i] = (n, -s)
    out = [(i, n, s) for i, (n, s) in sorted(first.items(), key=lambda x: (-x[1][1], x[0]))]
    return out + [(i, n, s) for i, (n, s) in sorted(rest.items(), key=lambda x: (-x[1][1], x[0])) if i not in first]


def test_append_search(spark, apps, terms):
    some = ["mapnotes", "notesmapmail", "qqq", "ditunotes", "n", "微信地图", "zz", "mb notes", "wxdt"]
    got = {}
    for r in R.append_search(ask(spark, some), apps, terms).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.app_id, r.part, r.score))
    for i, q in enumerate(some):
        assert got.get(i, []) == appended(q), q


def test_pairs_of_the_catalogue(spark, small):
    """The registered queries' own table, every search and every form of its names."""
    named = roles.named(spark, small)
    rows = R.with_distances(R.mixed(R.asked_forms(ask(spark, roles.RUNGS), named)), "f_name", "f_py", "f_abbr")
    q = F.col("q")
    got = rows.select("q", *R.FORM, R.typing_score(q).alias("typing"), R.combined_score(q).alias("combined"), "mixed", R.char_subset_score(q, F.col("f_name")).alias("subset")).collect()
    assert len(got) > 100
    for r in got:
        a = (0, r.f_name, r.f_py, r.f_en, r.f_abbr, r.f_cat, 0)
        assert (r.typing, r.combined, r.mixed) == (typing(r.q, a), combined(r.q, a), scrambled(r.q, a)), r
        shared = sum(min(r.q.count(c), r.f_name.count(c)) for c in set(r.q))
        if len(r.q) > len(r.f_name):
            assert r.subset == 0
        elif shared < len(r.q):
            assert r.subset == min(4, shared * 10 // len(r.q))
        else:
            assert 5 <= r.subset <= 9


@pytest.mark.parametrize("name", ["tolerant_search", "language_search", "append_search"])
def test_registered(spark, small, name):
    got = queries.REGISTRY[name][0](spark, small).collect()
    assert got and len({(r.query_id, r.app_id) for r in got}) == len(got) and all(1 <= r.rank <= 30 for r in got)
