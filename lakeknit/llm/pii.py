"""Personal data: candidate spans from many generators, judged by boosted trees, in DataFrame functions only."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of results; the first four have a base form that always counts.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Base forms. They begin where a run of their first characters does, or where the last match ended, and
#: never step back, so that long runs cost no more than their length; what they match is the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters without which a form can't match.
NEEDS = {"email": "@", "phone": "+"}
#: Generators of further candidates: kind, form.
MORE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]++(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9.+-])[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-]|[\x20][0-9])"),
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
)
CONTEXT = 24
CUES = r"(?i)(mail|e-mail|write|contact|call|phone|tel|fax|mobile|card|visa|account|pay|server|host|token|key|secret|passw|bearer)"
HARMLESS = r"(?i)(commit|sha|digest|checksum|version|isbn|order|invoice|page|table|figure|time)"
PREFIXES = r"^(sk_|pk_|ghp_|gho_|xox[a-z]-|AKIA|eyJ|glpat-)"
_FAR = 2**31 - 1
ROUNDS, RATE = 40, 0.3
#: Of the held-out examples of a kind over its threshold, at least so many are right.
PRECISION = 0.95
#: The trees' features, by name; all are numbers.
FEATURES = ("kind", "chars", "digits", "letters", "upper", "groups", "luhn", "cue", "harmless", "quoted", "assigned", "after_letter", "switches", "prefixed")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid(kind: str, s: Column) -> Column:
    """Whether a base form's match counts."""
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) <= 3) & (F.lpad(plain, 3, "0") <= "255")

        return F.forall(F.split(s, r"\."), small)
    n = F.length(digits_of(s))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", digits_of(s))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(x: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each number of an array that isn't empty, ``op`` over all before it.

    A fold that appends copies its result for each element. Here, chunks are folded first,
    then what comes before each chunk, then inside the chunks: about n ** 1.5 cheap steps.
    """
    first = F.lit(zero)

    def direct(v: Column, start: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i), start, op))

    def inside(chunks: Column) -> Column:
        before = direct(F.transform(chunks, lambda ch: F.aggregate(ch, first, op)), first)
        return _let(before, lambda b: F.flatten(F.transform(chunks, lambda ch, i: direct(ch, F.get(b, i)))))

    def cut(v: Column) -> Column:
        c = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / c).cast("int")), lambda i: F.slice(v, i * c + 1, c))

    return _let(x, lambda v: _let(cut(v), inside))


_PLACED = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def located(text: Column, found: Column, form: str) -> Column:
    """(start, end, value, before, after) of each match, in code points: the gaps that ``split`` leaves give the places and the context."""

    def whole(gaps: Column) -> Column:
        def placed(at: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(gaps, i))
                before = F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(CONTEXT))
                after = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(2))
                return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), before.alias("before"), after.alias("after"))

            return F.transform(found, one)

        return _let(running(F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v)), lambda x, y: x + y, 0), placed)

    return F.when(F.size(found) > 0, _let(F.split(text, form, -1), whole)).otherwise(F.array().cast(_PLACED))


def measures(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features of a candidate from its form and the characters around it."""
    digits = digits_of(value)
    return {
        "kind": kind.cast("double"),
        "chars": F.length(value).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")).cast("double"),
        "upper": F.length(F.regexp_replace(value, "[^A-Z]", "")).cast("double"),
        "groups": F.size(F.split(value, r"[^0-9A-Za-z]+", -1)).cast("double"),
        "luhn": F.coalesce(F.call_function("luhn_check", digits).cast("double"), F.lit(0.0)),
        "cue": before.rlike(CUES).cast("double"),
        "harmless": before.rlike(HARMLESS).cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "after_letter": before.rlike(r"\p{L}$").cast("double"),
        "prefixed": value.rlike(PREFIXES).cast("double"),
        "switches": (F.length(F.regexp_replace(value, "([0-9])[A-Za-z]|([A-Za-z])[0-9]", "$1$2#")) - F.length(F.regexp_replace(F.regexp_replace(value, "([0-9])[A-Za-z]|([A-Za-z])[0-9]", "$1$2#"), "#", ""))).cast("double"),
    }


def examples(n: int = 160, seed: int = 11) -> list[list[tuple[str, str, str, int]]]:
    """Made-up rounds of (kind, text before, candidate, label): forms of personal data, and look-alikes such as versions, words, digests and tables of numbers."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k=8: "".join(r.choice(letters) for _ in range(r.randint(3, k)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    base62 = lambda k: "".join(r.choice(letters + letters.upper() + "0123456789") for _ in range(k))
    some = lambda: f"{word()} {word()}{r.choice((' ', ', ', ': ', '. '))}"
    cue = lambda *c: f"{word()} {r.choice(c)}{r.choice((' ', ': ', ' is '))}"
    keyed = lambda: f"{word()} {r.choice(('token', 'key', 'secret', 'passwd', 'api_key'))}{r.choice((' = ', '=', ': '))}{r.choice(('', chr(34), chr(39)))}"

    def card(k: int) -> str:
        body = num(k - 1)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def one() -> list[tuple[str, str, str, int]]:
        return [
            ("email", some(), f"{word()}.{num(2)} [at] {word()} [dot] com", 1),
            ("email", cue("mail", "contact", "write"), f"{word()}(at){word()}.org", 1),
            ("email", some(), f"{word()} (at) {word(4)} . {word(3)}", 0),
            ("ip", cue("server", "host"), ":".join(hexa(4) for _ in range(8)), 1),
            ("ip", some(), f"{hexa(4)}:{hexa(4)}::{hexa(r.randint(1, 4))}", 1),
            ("ip", some(), ":".join(num(2) for _ in range(r.randint(3, 5))), 0),
            ("ip", cue("time", "page"), ":".join(num(2) for _ in range(3)), 0),
            ("card", some(), num(16), 0),
            ("card", cue("card", "visa", "account"), num(16), 1),
            ("card", cue("card", "visa"), " ".join(num(4) for _ in range(4)), 1),
            ("card", some(), ".".join(num(4) for _ in range(4)), 0),
            ("card", some(), num(r.choice((13, 14, 18))), 0),
            ("card", some(), "-".join([(c := card(16))[:4], c[4:8], c[8:12], c[12:]]), 1),
            ("phone", cue("call", "phone", "tel", "fax"), f"({num(3)}) 555-{num(4)}", 1),
            ("phone", some(), f"({num(3)}) {num(3)}-{num(4)}", 1),
            ("phone", cue("call", "mobile"), f"{num(3)}.{num(3)}.{num(4)}", 1),
            ("phone", some(), f"{num(4)} {num(3)} {num(4)}", 0),
            ("phone", cue("version", "table", "order"), f"{num(2)}.{num(3)}.{num(3)}", 0),
            ("secret", keyed(), hexa(r.choice((32, 40, 48, 64, 128))), 1),
            ("secret", keyed(), base62(r.randint(20, 90)), 1),
            ("secret", some(), r.choice(("sk_live_", "ghp_", "AKIA", "eyJ")) + base62(r.randint(18, 120)), 1),
            ("secret", cue("token:", "key:", "bearer"), hexa(40), 1),
            ("secret", cue("commit", "sha", "digest", "checksum"), hexa(r.choice((32, 40, 64))), 0),
            ("secret", some(), "".join(word(8) for _ in range(9))[: r.randint(20, 60)], 0),
            ("secret", some(), "-".join(word(8) for _ in range(r.randint(5, 9))), 0),
            ("secret", some(), "/".join(word(8) for _ in range(r.randint(5, 9))), 0),
            ("secret", some(), r.choice("=-_") * r.randint(20, 90), 0),
            ("secret", some(), num(r.randint(20, 60)), 0),
        ]

    return [one() for _ in range(n)]


class Trees:
    """Boosted trees of depth two for the log-odds of a candidate, and for each kind the threshold from which it counts."""

    def __init__(self, rows: list[list[float]], labels: list[int], rounds: list[int]) -> None:
        held = [i for i in range(len(rows)) if not rounds[i] % 4]  # every fourth round of examples
        x = np.array([r for r, k in zip(rows, rounds, strict=True) if k % 4])
        y = np.array([v for v, k in zip(labels, rounds, strict=True) if k % 4], dtype=float)
        values = [np.unique(x[:, f]) for f in range(len(FEATURES))]
        cuts = [(v[1:] + v[:-1]) / 2 for v in values]
        cuts = [c if len(c) <= 16 else c[np.arange(16) * len(c) // 16] for c in cuts]
        share = float(y.mean())
        self.base = math.log((share + 1e-3) / (1 - share + 1e-3))
        self.trees: list[tuple] = []
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(1e-3, p * (1 - p))

            def split(some: np.ndarray, grad: np.ndarray = grad, hess: np.ndarray = hess) -> tuple[int, float]:
                all_g, all_h, best = grad[some].sum(), hess[some].sum(), (0.0, 0, -1.0)
                for f, own in enumerate(cuts):
                    for c in own:
                        left = some & (x[:, f] <= c)
                        g, h = grad[left].sum(), hess[left].sum()
                        best = max(best, (g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1), f, float(c)))
                return best[1:]

            def leaf(some: np.ndarray, grad: np.ndarray = grad, hess: np.ndarray = hess) -> float:
                return float(RATE * grad[some].sum() / (hess[some].sum() + 1))

            f, c = split(np.ones(len(y), dtype=bool))
            sides = []
            for side in (x[:, f] <= c, x[:, f] > c):
                g, d = split(side)
                sides.append((g, d, leaf(side & (x[:, g] <= d)), leaf(side & (x[:, g] > d))))
            self.trees.append((f, c, *sides))
            (g0, d0, a0, b0), (g1, d1, a1, b1) = sides
            score += np.where(x[:, f] <= c, np.where(x[:, g0] <= d0, a0, b0), np.where(x[:, g1] <= d1, a1, b1))
        self.thresholds = [self.calibrated([(self.score(rows[i]), labels[i]) for i in held if rows[i][0] == k]) for k in range(len(KINDS))]

    @staticmethod
    def calibrated(scores: list[tuple[float, int]]) -> float:
        """The lowest threshold over which PRECISION of the examples are right, half way to the next score below it."""
        ranked = sorted(scores, reverse=True)
        out, right = math.inf, 0
        for k, (s, y) in enumerate(ranked, 1):
            right += y
            below = ranked[k][0] if k < len(ranked) else s - 1
            if below < s and right >= PRECISION * k:
                out = (s + below) / 2
        return out

    @staticmethod
    def step(tree: tuple, row: list[float]) -> float:
        f, c, low, high = tree
        g, d, a, b = low if row[f] <= c else high
        return a if row[g] <= d else b

    def score(self, row: list[float]) -> float:
        return self.base + sum(self.step(t, row) for t in self.trees)

    def column(self, feature: dict[str, Column]) -> Column:
        """The same score as an expression."""
        out = F.lit(self.base)
        for f, c, low, high in self.trees:
            half = [F.when(feature[FEATURES[g]] <= d, a).otherwise(b) for g, d, a, b in (low, high)]
            out = out + F.when(feature[FEATURES[f]] <= c, half[0]).otherwise(half[1])
        return out


_fitted: dict[int, Trees] = {}


def features_of(spark: SparkSession, made: list[tuple[str, str, str, int]]) -> list[list[float]]:
    """The features of examples, from the same expressions that judge documents."""
    rows = spark.createDataFrame([(i, KINDS.index(k), b, c, b[-1] if b[-1:] in ("'", '"') else " ") for i, (k, b, c, _) in enumerate(made)], "i int, kind int, before string, value string, after string")
    own = measures(F.col("kind"), F.col("value"), F.right("before", F.lit(CONTEXT)), F.col("after"))
    return [[float(x) for x in r[1:]] for r in rows.select("i", *[own[k].alias(k) for k in FEATURES]).orderBy("i").collect()]


def fit(spark: SparkSession, seed: int = 11) -> Trees:
    """Learn the trees from ``examples``."""
    if seed not in _fitted:
        rounds = examples(seed=seed)
        made = [x for one in rounds for x in one]
        _fitted[seed] = Trees(features_of(spark, made), [y for *_, y in made], [i for i, one in enumerate(rounds) for _ in one])
    return _fitted[seed]


_EVENT = "array<struct<start:int,own:int,end:int,k:int,value:string,before:string,after:string>>"
_SPANS = "array<struct<k:int,start:int,end:int>>"


def _greatest(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def free_of(base: Column, more: Column) -> Column:
    """The candidates (events) that overlap no base span: in the order of starts, the furthest end before and the next start after decide."""
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), b["k"].alias("k"), F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after")))

    def tested(x: Column) -> Column:
        ends = running(F.transform(x, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(F.lit(0))), _greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(F.lit(_FAR)))), _least, _FAR))
        return _let(ends, lambda before: _let(starts, lambda after: F.filter(x, lambda e, i: (e["own"] == 1) & (F.get(before, i) <= e["start"]) & (F.get(after, i) >= e["end"]))))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), _let(F.array_sort(F.concat(spans.cast(_EVENT), more)), tested)).otherwise(more)


def grouped(x: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """``f`` of sorted spans, of where each first one of a group of overlapping ones is, and of the furthest end before each span."""
    upto = running(F.transform(x, lambda s: s["end"]), _greatest, 0)
    return _let(upto, lambda u: _let(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["start"] >= F.get(u, i)), lambda heads: f(x, heads, u)))


def best_of(scored: Column) -> Column:
    """Of overlapping spans, the one of the highest score stays, then the next that is free of those that stay, and so on."""

    def settle(x: Column, heads: Column, _: Column) -> Column:
        def one(group: Column) -> Column:
            ranked = F.array_sort(F.transform(group, lambda s: F.struct((-s["score"]).alias("cost"), s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
            none = F.array().cast("array<struct<cost:double,start:int,end:int,k:int>>")
            kept = F.aggregate(ranked, none, lambda acc, s: F.when(F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(s))))
            return F.transform(kept, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))

        groups = F.transform(heads, lambda h, j: F.slice(x, h + 1, F.coalesce(F.get(heads, j + 1), F.size(x)) - h))
        return F.flatten(F.transform(groups, one))

    return F.when(F.size(scored) > 0, _let(F.array_sort(scored), lambda x: grouped(x, settle))).otherwise(F.array().cast(_SPANS))


def find(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, base, spans) of every document row, in its own task: nothing is shuffled.

    base: arrays of (kind, start, end) of the base forms, by kind, then start. spans: the same
    and the further candidates that the trees accept and that overlap no base span; of overlapping
    ones, the better scored. A null text counts as empty and stays null. Null or repeated
    ids stay; ``carry`` names further columns to keep; others are not read. A very long text
    costs little more than its length, however many matches it has.
    """
    work = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry], F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    t = F.col("__t")
    digit = t.rlike("[0-9]")
    may = {k: t.contains(NEEDS[k]) if k in NEEDS else digit for k in BASE}
    none = F.array().cast("array<string>")
    forms = [(f"__b_{k}", k, BASE[k], may[k]) for k in BASE]
    gate = {"email": t.rlike(r"[\[({]at[\])}]"), "ip": t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "card": digit, "phone": digit, "secret": F.lit(True)}
    forms += [(f"__m_{i}", k, form, gate[k]) for i, (k, form) in enumerate(MORE)]
    work = work.withColumns({name: F.when(ok, F.regexp_extract_all(t, F.lit(form), F.lit(0))).otherwise(none) for name, _, form, ok in forms})
    work = work.withColumns({name: located(t, F.col(name), form) for name, _, form, _ in forms})

    def counted(kind: str) -> Column:
        return F.transform(F.filter(f"__b_{kind}", lambda x: valid(kind, x["value"])), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("start"), x["end"].alias("end")))

    def candidates(name: str, kind: str) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("own"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("k"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    work = work.withColumn("__base", F.concat(*map(counted, BASE)).cast(_SPANS)).withColumn("__more", F.concat(*[candidates(f"__m_{i}", k) for i, (k, _) in enumerate(MORE)]).cast(_EVENT))
    work = work.withColumn("__free", free_of(F.col("__base"), F.col("__more")))
    least = F.array(*[F.lit(float(x)) for x in trees.thresholds])

    def judged(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"), trees.column(measures(x["k"], x["value"], x["before"], x["after"])).alias("score"))

    work = work.withColumn("__good", F.filter(F.transform("__free", judged), lambda x: x["score"] >= F.get(least, x["k"])))
    work = work.withColumn("spans", F.array_sort(F.concat(F.col("__base"), best_of(F.col("__good")))))
    return work.select("doc_id", *carry, "text", F.col("__base").alias("base"), "spans")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a group of overlapping spans by the first one's."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # Taking many pieces by their places would count characters from the start each time.
    letters = F.when(F.size(spans) > 32, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))

    def cut(x: Column, heads: Column, upto: Column) -> Column:
        def pieces(c: Column) -> Column:
            def piece(a: Column, b: Column) -> Column:
                return F.when(c.isNull(), F.substring(text, a + 1, b - a)).otherwise(F.array_join(F.slice(c, a + 1, b - a), ""))

            last = F.greatest(F.get(upto, F.size(x) - 1), F.get(x, F.size(x) - 1)["end"])
            return F.concat(F.array_join(F.transform(heads, lambda h: F.concat(piece(F.get(upto, h), F.get(x, h)["start"]), F.get(names, F.get(x, h)["k"]))), ""), piece(last, F.greatest(last, F.length(text))))

        return _let(letters, pieces)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    return F.when(F.size(spans) > 0, _let(ordered, lambda x: grouped(x, cut))).otherwise(text)
