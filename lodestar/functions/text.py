"""Text functions: Column in, Column out, all in the JVM.

Missing text counts as empty wherever a function says "text"; comparisons of characters are by code point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4E00}-\x{9FA5}"
T9_LETTERS, T9_DIGITS = "abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, f) -> Column:
    """``f`` of the value, which is made once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Trimmed text."""
    return F.trim(text(c))


def lowered(c: Column) -> Column:
    """Trimmed lower-case text."""
    return F.lower(normalize(c))


def full_normalize(c: Column) -> Column:
    """Without invisible and control characters, full-width forms made half-width, lower case, white space collapsed, trimmed."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    half = "".join(chr(0x21 + i) for i in range(94)) + " "
    seen = F.regexp_replace(text(c), r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]", "")
    seen = F.regexp_replace(seen, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(F.translate(seen, wide, half)), r"\s+", " "))


def chars(c: Column) -> Column:
    """Array of characters; of an empty text, empty."""
    return F.filter(F.split(text(c), ""), lambda x: x != "")


def detect_language(c: Column, syllables: list[str]) -> Column:
    """zh, en, pinyin, mixed or unknown, by script and a dictionary of syllables (tokens of up to six letters)."""
    t = F.lower(normalize(c))
    han, latin = t.rlike(f"[{CJK}]"), t.rlike("[a-z]")
    tokens = F.split(t, r"\s+")
    known = F.array(*[F.lit(s) for s in syllables])
    all_known = F.forall(tokens, lambda x: (F.length(x) <= 6) & F.array_contains(known, x))
    return (
        F.when(t == "", "unknown").when(han & latin, "mixed").when(han, "zh").when(latin & t.rlike(r"^[a-z\s]+$") & all_known, "pinyin").when(latin, "en").otherwise("unknown")
    )


def input_language(c: Column) -> Column:
    """ENGLISH, CHINESE, NUMERIC_T9 or MIXED."""
    t = normalize(c)
    han, latin, digit = t.rlike(f"[{CJK}]"), t.rlike("[A-Za-z]"), t.rlike("^[2-9]+$")
    return F.when(digit, "NUMERIC_T9").when(han & latin, "MIXED").when(han, "CHINESE").when(latin, "ENGLISH").otherwise("MIXED")


def mode_count(c: Column) -> Column:
    """How often the most frequent character occurs."""
    all_ = chars(c)
    return F.coalesce(F.array_max(F.transform(F.array_distinct(all_), lambda x: F.size(F.filter(all_, lambda y: y == x)))), F.lit(0))


def sanitize(c: Column) -> Column:
    """The query to search for, or null if it is rejected: length 2 to 40, some letter, digit or CJK character, digits only if
    all could be keypad ones, no character over 0.6 of four or more, no control characters. Runs of eight and more become three."""
    q = normalize(c)
    n = F.length(q)
    ok = (n >= 2) & (n <= 40) & q.rlike(f"[{CJK}a-zA-Z0-9]") & (~q.rlike(r"^\d+$") | q.rlike("^[2-9]+$"))
    ok &= ~((mode_count(q) / n > 0.6) & (n >= 4)) & ~q.rlike(r"[\x00-\x1f\x7f]")
    return F.when(ok, F.regexp_replace(q, r"(.)\1{7,}", "$1$1$1"))


def compress_runs(c: Column, most: int = 3) -> Column:
    """No character more than ``most`` times in a row."""
    return F.regexp_replace(text(c), r"(.)\1{%d,}" % most, "$1" * most)


def sanitize_reason(c: Column) -> Column:
    """Why the strict sanitiser rejects a query, or null."""
    q = normalize(c)
    n = F.length(q)
    return (
        F.when(n == 0, "empty")
        .when(n < 2, "too_short")
        .when(n > 40, "too_long")
        .when(~q.rlike(f"[{CJK}a-zA-Z0-9]"), "no_alnum_or_cjk")
        .when(q.rlike(r"[\x00-\x1f\x7f]"), "control_chars")
        .when((n >= 3) & (mode_count(q) / n >= 0.6), "repetition_too_high")
        .when(F.length(compress_runs(q)) < 2, "after_compress_too_short")
    )


def is_short(c: Column) -> Column:
    return F.length(F.regexp_replace(text(c), r"\s+", "")) <= 2


def unique_strings(a: Column) -> Column:
    """Distinct strings of an array regardless of case and outer spaces, the first spelling kept, empty ones dropped."""
    trimmed = F.filter(F.transform(a, lambda x: normalize(x)), lambda x: x != "")
    return F.filter(trimmed, lambda x, i: F.array_position(F.transform(trimmed, F.lower), F.lower(x)) == i + 1)


def t9(c: Column) -> Column:
    """Keypad digits of the letters and digits; everything else is dropped."""
    return F.regexp_replace(F.translate(F.lower(text(c)), T9_LETTERS, T9_DIGITS), "[^0-9]", "")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of the character sets. An empty side gives 0, two of them ``both_empty``."""
    x, y = F.array_distinct(chars(a)), F.array_distinct(chars(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(x, y)) / both)


def ngrams(c: Column, n: int) -> Column:
    """The runs of ``n`` characters, in order, with repeats."""
    t = text(c)
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    x, y = F.array_distinct(ngrams(a, n)), F.array_distinct(ngrams(b, n))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared characters over the larger character set."""
    x, y = F.array_distinct(chars(a)), F.array_distinct(chars(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def _walk(q: Column, t: Column, start: Column, step, finish) -> Column:
    """Match the characters of ``q`` in ``t`` from left to right, each at its first place after the one before."""
    return F.aggregate(chars(q), start, lambda s, ch: step(s, _locate(ch, t, s["at"])), finish)


def _locate(ch: Column, t: Column, after: Column) -> Column:
    """1-based place of ``ch`` in ``t`` after the place ``after``, else 0."""
    rest = F.instr(F.substring(t, after + 1, F.length(t)), ch)
    return F.when(rest > 0, rest + after).otherwise(0)


def contain_ratio(q: Column, t: Column) -> Column:
    """Share of the characters of ``q`` found in ``t`` in order; one that isn't found is passed over."""
    q, t = text(q), text(t)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    hits = _walk(q, t, start, lambda s, p: F.when(p > 0, F.struct(p.alias("at"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    return F.when(F.length(q) == 0, F.lit(0.0)).otherwise(hits / F.length(q))


def is_subsequence(q: Column, t: Column) -> Column:
    q, t = text(q), text(t)
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))
    ok = _walk(q, t, start, lambda s, p: F.struct(F.when(p > 0, p).otherwise(s["at"]).alias("at"), (s["ok"] & (p > 0)).alias("ok")), lambda s: s["ok"])
    return (F.length(q) > 0) & (F.length(t) > 0) & ok


def subsequence_score(q: Column, t: Column) -> Column:
    """30 for each letter right after the one before, times the length of the streak; else 15 less 3 a skipped letter (20 at
    most). At least 50; 0 if ``q`` isn't a subsequence of ``t``."""
    q, t = text(q), text(t)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("streak"), F.lit(0).alias("score"), F.lit(True).alias("ok"))

    def step(s, p):
        near = p == s["at"] + 1
        gap = F.when(s["at"] > 0, F.least((p - s["at"] - 1) * 3, F.lit(20))).otherwise(0)
        return F.struct(
            F.when(p > 0, p).otherwise(s["at"]).alias("at"),
            F.when(near, s["streak"] + 1).otherwise(0).alias("streak"),
            (s["score"] + F.when(near, 30 * (s["streak"] + 1)).otherwise(F.lit(15) - gap)).alias("score"),
            (s["ok"] & (p > 0)).alias("ok"),
        )

    total = _walk(q, t, start, step, lambda s: F.when(s["ok"], F.greatest(F.lit(50), s["score"])).otherwise(0))
    return F.when((F.length(q) == 0) | (F.length(t) == 0), 0).otherwise(total)


def continuity(q: Column, t: Column) -> Column:
    """49 for a subsequence without gaps down to 0 by the letters skipped inside; 0 if it is none."""
    q, t = text(q), text(t)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(True).alias("ok"))

    def step(s, p):
        return F.struct(
            F.when(p > 0, p).otherwise(s["at"]).alias("at"), F.when(s["first"] == 0, p).otherwise(s["first"]).alias("first"), (s["ok"] & (p > 0)).alias("ok")
        )

    slack = F.length(t) - F.length(q)
    gaps = _walk(q, t, start, step, lambda s: F.when(s["ok"], s["at"] - s["first"] + 1 - F.length(q)).otherwise(F.lit(-1)))
    return F.when((F.length(q) == 0) | (gaps < 0), 0).when(slack == 0, 49).otherwise(F.floor(49 * (1 - gaps / slack)).cast("int"))


def adjacent_swap(q: Column, t: Column) -> Column:
    """Whether ``t`` contains ``q`` with two neighbouring characters exchanged."""
    q, t = text(q), text(t)
    n = F.length(q)

    def swapped(i):
        return F.concat(F.substring(q, F.lit(1), i - 1), F.substring(q, i + 1, F.lit(1)), F.substring(q, i, F.lit(1)), F.substring(q, i + 2, n))

    return (n >= 2) & F.coalesce(F.exists(F.when(n >= 2, F.sequence(F.lit(1), n - 1)), lambda i: t.contains(swapped(i))), F.lit(False))


def disorder(q: Column, t: Column) -> Column:
    """Whether every character of ``q`` occurs in ``t``."""
    return (F.length(text(q)) > 0) & (F.size(F.array_except(chars(q), chars(t))) == 0)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, or the difference in length where that exceeds half the total length plus two."""
    a, b = text(a), text(b)
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(gap > (F.length(a) + F.length(b)) / 2 + 2, gap).otherwise(F.levenshtein(a, b))


KEYS = {ch: (r, c) for r, row in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for c, ch in enumerate(row)}
_STAGGER = (0.0, 0.5, 1.25)


def key_distance(a: str, b: str) -> float:
    """Distance of two keys on a staggered keyboard; 8 for a character without a key."""
    if a == b:
        return 0.0
    if a not in KEYS or b not in KEYS:
        return 8.0
    (ra, ca), (rb, cb) = KEYS[a], KEYS[b]
    dr, dc = abs(ra - rb), abs(ca + _STAGGER[ra] - cb - _STAGGER[rb])
    return (dr * dr * 1.6 + dc * dc) ** 0.5 + (0.15 if dr and dc else 0.0)


def grid_distance(a: str, b: str) -> float:
    """Straight distance on an unstaggered keyboard; 8 for a character without a key."""
    if a == b:
        return 0.0
    if a not in KEYS or b not in KEYS:
        return 8.0
    return ((KEYS[a][0] - KEYS[b][0]) ** 2 + (KEYS[a][1] - KEYS[b][1]) ** 2) ** 0.5


def _factors(distance, sigma: float) -> Column:
    import math

    pairs = [x for a in KEYS for b in KEYS if a != b for x in (F.lit(a + b), F.lit(math.exp(-distance(a, b) ** 2 / (2 * sigma * sigma))))]
    return F.create_map(*pairs)


def gaussian_factor(q: Column, t: Column, sigma: float = 2.0) -> Column:
    """Mean closeness of the keys at the first three places of both; 1 if either is empty."""
    import math

    q, t = F.lower(text(q)), F.lower(text(t))
    table, far = _factors(key_distance, sigma), math.exp(-64 / (2 * sigma * sigma))
    n = F.least(F.length(q), F.length(t), F.lit(3))

    def near(i):
        a, b = F.substring(q, i, F.lit(1)), F.substring(t, i, F.lit(1))
        return F.when(a == b, 1.0).otherwise(F.coalesce(F.element_at(table, F.concat(a, b)), F.lit(far)))

    total = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)), F.lit(0.0), lambda s, i: s + near(i))
    return F.when(n == 0, F.lit(1.0)).otherwise(total / n)


def typing_factor(q: Column, sigma: float = 1.5) -> Column:
    """Product of the closeness of consecutive keys of ``q``."""
    import math

    q = F.lower(text(q))
    table, far = _factors(grid_distance, sigma), math.exp(-64 / (2 * sigma * sigma))
    n = F.length(q)

    def near(i):
        a, b = F.substring(q, i, F.lit(1)), F.substring(q, i + 1, F.lit(1))
        return F.when(a == b, 1.0).otherwise(F.coalesce(F.element_at(table, F.concat(a, b)), F.lit(far)))

    return F.when(n < 2, F.lit(1.0)).otherwise(F.aggregate(F.when(n >= 2, F.sequence(F.lit(1), n - 1)), F.lit(1.0), lambda s, i: s * near(i)))


NEIGHBOURS = {a: sorted(b for b in KEYS if b != a and abs(KEYS[a][0] - KEYS[b][0]) <= 1 and abs(KEYS[a][1] - KEYS[b][1]) <= 1) for a in KEYS}


def is_neighbour(a: Column, b: Column) -> Column:
    """Whether two keys touch."""
    table = F.create_map(*[x for k, v in NEIGHBOURS.items() for x in (F.lit(k), F.lit("".join(v)))])
    return F.coalesce(F.element_at(table, F.lower(a)).contains(F.lower(b)), F.lit(False))


def soundex(c: Column) -> Column:
    """Four characters; vowels, h, w and y part equal codes. Empty text gives 0000."""
    t = F.upper(F.regexp_replace(text(c), "[^A-Za-z]", ""))
    code = F.translate(t, "AEIOUHWYBFPVCGJKQSXZDTLMNR", "00000000111122222222334556")
    start = F.struct(F.lit("").alias("out"), F.substring(code, 1, 1).alias("last"))
    rest = F.aggregate(
        chars(F.substring(code, F.lit(2), F.length(code))),
        start,
        lambda s, d: F.struct(F.when((d != "0") & (d != s["last"]), F.concat(s["out"], d)).otherwise(s["out"]).alias("out"), d.alias("last")),
        lambda s: s["out"],
    )
    return F.when(t == "", "0000").otherwise(F.rpad(F.substring(F.concat(F.substring(t, 1, 1), rest), 1, 4), 4, "0"))


def initials(c: Column) -> Column:
    """First letters of the words."""
    return F.array_join(F.transform(F.filter(F.split(normalize(c), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def latin_name(c: Column) -> Column:
    """ASCII letters and digits alone, lower case."""
    return F.lower(F.regexp_replace(text(c), "[^A-Za-z0-9]", ""))


def lexical_tokens(c: Column) -> Column:
    """Search tokens: Latin words, numbers, CJK characters, then pairs of consecutive CJK characters, gaps bridged; repeats kept."""
    t = F.lower(text(c))
    none = F.array().cast("array<string>")
    pairs = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.concat(F.element_at(h, i), F.element_at(h, i + 1)))
    # the characters are found once, and only in texts that have any
    han = F.transform(F.array(F.regexp_extract_all(t, F.lit(f"[{CJK}]"), F.lit(0))), lambda h: F.concat(h, F.when(F.size(h) > 1, pairs(h)).otherwise(none)))
    return F.concat(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)), F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), F.when(t.rlike(f"[{CJK}]"), F.element_at(han, 1)).otherwise(none))


def lexical_length(c: Column) -> Column:
    """How many search tokens there are, without making them."""
    t = F.lower(text(c))
    han = F.when(t.rlike(f"[{CJK}]"), F.regexp_count(t, F.lit(f"[{CJK}]")) * 2 - 1).otherwise(0)
    return F.regexp_count(t, F.lit("[a-z]+")) + F.regexp_count(t, F.lit("[0-9]+")) + han


def boundary_grams(c: Column) -> Column:
    """^first, the pairs, last$ of the lower-case text."""
    t = lowered(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.concat(F.lit("^"), F.substring(t, 1, 1))), ngrams(t, 2), F.array(F.concat(F.substring(t, -1, 1), F.lit("$"))))
    )


def intents(c: Column, dictionary: dict[str, list[str]]) -> Column:
    """The names whose words the text contains, in the dictionary's order."""
    t = lowered(c)
    hits = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: t.contains(w)), F.lit(name)) for name, words in dictionary.items()]
    return F.array_compact(F.array(*hits))


def is_similar(a: Column, b: Column) -> Column:
    """Whether two queries start alike (two characters) or share half of the longer one's characters."""
    x, y = lowered(a), lowered(b)
    longest = F.greatest(F.length(x), F.length(y))
    shared = F.size(F.filter(chars(x), lambda ch: y.contains(ch)))
    start = (F.length(x) >= 2) & (F.length(y) >= 2) & (F.substring(x, 1, 2) == F.substring(y, 1, 2))
    return (longest > 0) & (start | (shared / longest >= 0.5))


def prefixes(c: Column, least: int, most: int) -> Column:
    """Prefixes of ``least`` to ``most`` characters."""
    t = text(c)
    n = F.least(F.lit(most), F.length(t))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda i: F.substring(t, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many characters two texts share, each as often as in the one that has it less."""
    x, y = chars(a), chars(b)
    count = lambda s, ch: F.size(F.filter(s, lambda z: z == ch))
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda n, ch: n + F.least(count(x, ch), count(y, ch)))


def syllable_match(q: Column, syllables: Column) -> Column:
    """Matched syllables of the query, consumed from the left by whole syllables or their first letters; 0 if any of it is left."""
    q = lowered(q)
    start = F.struct(q.alias("rest"), F.lit(0).alias("n"))

    def step(s, y):
        whole, first = s["rest"].startswith(y) & (y != ""), s["rest"].startswith(F.substring(y, 1, 1)) & (y != "")
        rest = lambda k: F.struct(F.substring(s["rest"], k + 1, F.length(s["rest"])).alias("rest"), (s["n"] + 1).alias("n"))
        return F.when(whole, rest(F.length(y))).when(first & (s["rest"] != ""), rest(F.lit(1))).otherwise(s)

    return F.when(q == "", 0).otherwise(F.aggregate(syllables, start, step, lambda s: F.when(s["rest"] == "", s["n"]).otherwise(0)))
