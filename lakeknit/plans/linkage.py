"""The steps of record linkage, each one SQL statement over the steps before it.

Spark runs a step as a DataFrame over its inputs' DataFrames, so Catalyst plans the whole
chain at once; the same statements, as common table expressions, are the check in DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import legacy as lg
from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.dialect import DuckDB, Spark
from .profiles import V30, Profile


def entities(d: Spark, p: Profile) -> str:
    """Records of three sources out of the documents: four words are the name, three the address."""
    words = d.keep(d.split(d.unmarked("coalesce(text, '')"), r"[^\p{L}\p{N}]+"), "t", "t <> ''")
    code = f"lpad(CAST(({d.size('w')} * 7919) % 90000 + 10000 AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), 5, '0')"
    s = "STRING" if d.name == "spark" else "VARCHAR"
    part = lambda a, n: d.join(f"{'slice' if d.name == 'spark' else 'list_slice'}(w, {a}, {n if d.name == 'spark' else a + n - 1})", " ")
    return f"""SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END, lpad(CAST(doc_id AS {s}), 8, '0')) AS entity_id,
  concat({part(1, 4)}, CASE doc_id % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Ltd' ELSE ' Corp.' END) AS business_name,
  concat(CAST({d.size("w")} % 400 + 1 AS {s}), ' ', {part(5, 3)}, CASE doc_id % 2 WHEN 0 THEN ' Road' ELSE ' Street' END, ' ', {code}) AS business_address,
  lang AS country, CASE WHEN {d.size("w")} >= 12 THEN concat(lang, ':', {part(1, 12)}) END AS truth_key
FROM (SELECT doc_id, lang, {words} AS w FROM @documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL) AS x"""


def head_sample(d: Spark, p: Profile) -> str:
    """The first 30,000 targets by id."""
    return "SELECT * FROM @entities WHERE left(entity_id, 2) <> 'S1' ORDER BY entity_id LIMIT 30000"


def records(d: Spark, p: Profile) -> str:
    """Normalised records: everything that keys and features need, once for each entity.

    ``stops`` are the country's frequent address words, a short list, as each is in 3 of 100 records.
    """
    stops = f"coalesce(s.stops, {d.empty})" if p.stops else d.empty
    gathered = "array_sort(collect_set(word))" if d.name == "spark" else "list_sort(list(DISTINCT word))"
    told = f"LEFT JOIN (SELECT country AS stop_country, {gathered} AS stops FROM @stopwords GROUP BY country) AS s ON e.country = s.stop_country" if p.stops else ""
    if p.names == "india":
        names = f"{lg.name_ascii(d, 'business_name')} AS name, {lg.address_ascii(d, 'business_address')} AS addr"
    else:
        names = f"{tx.clean_name(d, 'low_name', p.extra_suffixes)} AS name, {tx.clean_address(d, 'low_addr', 'stops' if p.stops else None)} AS addr"
    numbers = d.each(d.all("raw_addr", r"\b[0-9]+\b"), "t", "t")
    digits = tx.address_digits(d, "raw_addr") if p.names != "india" else d.first(numbers, 1)
    postal = tx.postal_code(d, "raw_addr", "country") if p.names != "india" else tx.postal_code(d, "raw_addr", "'India'")
    return f"""SELECT entity_id, left(entity_id, 2) AS src, country, truth_key, name, {tx.tokens(d, "name")} AS name_tokens, addr, {tx.tokens(d, "addr")} AS addr_tokens,
  {digits} AS digits, {tx.complex_codes(d, "raw_addr")} AS codes, {postal} AS postal, {tx.phone(d, "concat(raw_name, ' ', addr)")} AS phone, {lg.care_of(d, "raw_addr")} AS care_of, stops
FROM (SELECT entity_id, country, truth_key, raw_name, raw_addr, stops, {names}
  FROM (SELECT entity_id, country, truth_key, business_name, business_address, coalesce(business_name, '') AS raw_name, coalesce(business_address, '') AS raw_addr, {stops} AS stops, {tx.universal(d, "business_name")} AS low_name, {tx.universal(d, "business_address")} AS low_addr FROM @entities AS e {told}) AS a) AS b"""


def profiles(d: Spark, p: Profile) -> str:
    """Records with their derived names: acronym, sound, distinctiveness, n-grams."""
    return f"""SELECT *, {tx.acronym(d, "name_tokens")} AS acronym, {tx.distinctiveness(d, "name", "name_tokens")} AS distinct_score,
  {tx.soundex(d, d.at("name_tokens", 1))} AS sound1, {tx.soundex(d, d.at("name_tokens", 2))} AS sound2,
  {tx.ngrams(d, "name", 2)} AS grams2, {tx.ngrams(d, "name", 3)} AS grams3, {tx.ngrams(d, "addr", 3)} AS addr3,
  {d.keep("addr_tokens", "t", "NOT " + d.like("t", "^[0-9]+$"))} AS streets
FROM @records"""


def keys(d: Spark, p: Profile) -> str:
    """Blocking keys: one row for each channel and value of a record, repeats included."""
    t1, t2 = (f"coalesce({d.at('name_tokens', i)}, '')" for i in (1, 2))
    two = f"{d.size('name_tokens')} >= 2"
    one = lambda cond, v: f"CASE WHEN {cond} THEN {d.array(v)} ELSE {d.empty} END"
    sort2 = lambda a, b: f"concat(least({a}, {b}), '_', greatest({a}, {b}))"
    number = f"coalesce({d.at('digits', 1)}, '')"
    plain = f"NOT {d.has(d.strings(tx.STREET_WORDS), 't')} AND NOT {d.has('stops', 't')}"
    long_streets = d.keep("streets", "t", f"length(t) >= 3 AND {plain}")
    street = lambda i: one(f"{number} <> '' AND {d.size(long_streets)} >= {i}", f"concat({number}, '_', {d.at(long_streets, i)})")
    short_name = "length(name) BETWEEN 2 AND 5"
    rules = {
        "ex": one("length(name) >= 3", "name"),
        "bi_sort": one(two, sort2(t1, t2)),
        "bi": one(two, f"concat({t1}, '_', {t2})"),
        "comp": one(f"{two} AND length({t1}) >= 3 AND length({t2}) >= 3", f"concat({t1}, {t2})"),
        "comp:sorted": one(two, f"concat(least({t1}, {t2}), greatest({t1}, {t2}))"),
        "trunc": one("length(name) >= 14", "left(name, 12)"),
        "ph_name": f"CASE WHEN {two} AND sound1 <> '' AND sound2 <> '' THEN {d.array(sort2('sound1', 'sound2'))} WHEN {d.size('name_tokens')} = 1 AND length({t1}) >= 4 AND sound1 <> '' THEN {d.array('sound1')} ELSE {d.empty} END",
        "acr": d.concat(one("length(acronym) >= 2", "acronym"), one(f"{d.size('name_tokens')} = 1 AND {short_name}", "name")),
        "acr:plain": d.concat(one("length(acronym) >= 2", "acronym"), one(f"{short_name} AND {d.like('name', r'^[\p{L}\p{N}]+$')}", "name")),
        "tk": d.keep(d.first("name_tokens", 3), "t", f"length(t) >= 3 AND {plain}"),
        "tk:all": d.keep("name_tokens", "t", f"length(t) >= 4 AND NOT ({d.like('t', r'^\p{N}+$')})"),
        "tk:two": d.keep(d.first("name_tokens", 2), "t", "length(t) >= 5"),
        "addr_st": d.concat(street(1), street(2)),
        "addr_st:pair": one(f"{number} <> '' AND {d.size(long_streets)} > 0", f"concat({number}, '_', {d.join(d.first(long_streets, 2), '_')})"),
        "addr_num_st": street(1),
        "addr_num_st2": street(2),
        "addr_co": one(f"{d.size('care_of')} >= 2", f"concat({d.at('care_of', 1)}, '_', {d.at('care_of', 2)})"),
        "code": "codes",
        "post_num": one(f"postal <> '' AND {number} <> ''", f"concat(postal, '_', {number})"),
        "phone": one("length(phone) = 10", "phone"),
        "np": one(f"{number} <> '' AND name <> ''", f"concat({number}, '_', left(name, 2))"),
        "pp": one("postal <> '' AND name <> ''", "concat(postal, '_', left(name, 2))"),
    }
    kind = lambda ch: ch.partition(":")[0]
    if d.name == "spark":
        # One pass over the records instead of one for each channel.
        tagged = d.concat(*[d.each(rules[ch], "v", f"struct('{kind(ch)}' AS ch, v AS val)") for ch in p.weights])
        return f"SELECT entity_id, src, country, k.ch AS ch, k.val AS val FROM @profiles LATERAL VIEW explode({tagged}) AS k"
    return " UNION ALL ".join(f"SELECT entity_id, src, country, '{kind(ch)}' AS ch, unnest({rules[ch]}) AS val FROM @profiles" for ch in p.weights)


def weights(d: Spark, p: Profile) -> str:
    """Keys that both sides have and few enough targets share, weighted by rarity."""
    base = " ".join(f"WHEN '{ch.partition(':')[0]}' THEN CAST({w} AS DOUBLE)" for ch, w in p.weights.items())
    rarity = f"greatest(CAST(0.2 AS DOUBLE), 1 - ln(n) / ln({p.bucket + 1}))" if p.damped else "CAST(1 AS DOUBLE)"
    return f"""SELECT t.country, t.ch, t.val, n, {d.round(f'CASE t.ch {base} END * {rarity}', 9)} AS w
FROM (SELECT country, ch, val, count(*) AS n FROM @keys WHERE src <> 'S1' GROUP BY country, ch, val HAVING count(*) <= {p.bucket}) AS t
LEFT SEMI JOIN (SELECT DISTINCT country, ch, val FROM @keys WHERE src = 'S1') AS s ON t.country = s.country AND t.ch = s.ch AND t.val = s.val""".replace("LEFT SEMI JOIN", "LEFT SEMI JOIN" if d.name == "spark" else "SEMI JOIN")


def candidates(d: Spark, p: Profile) -> str:
    """The best targets of each first-source record by the summed weights of shared keys; ties by id."""
    return f"""SELECT s1_id, cand_id, country, score, CAST(rn - 1 AS BIGINT) AS rank_no FROM (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rn FROM (
    SELECT s.entity_id AS s1_id, t.entity_id AS cand_id, s.country, {d.round(d.total("w.w", 9), 6)} AS score
    FROM @keys AS s JOIN @weights AS w ON s.country = w.country AND s.ch = w.ch AND s.val = w.val
    JOIN @keys AS t ON t.country = w.country AND t.ch = w.ch AND t.val = w.val
    WHERE s.src = 'S1' AND t.src <> 'S1' GROUP BY s.entity_id, t.entity_id, s.country) AS g) AS r
WHERE rn <= {p.top}"""


def features(d: Spark, p: Profile) -> str:
    """The pair vector: 35 numbers in a fixed order, and three more."""
    return vectors(d, "@candidates AS c JOIN @profiles AS x ON c.s1_id = x.entity_id JOIN @profiles AS y ON c.cand_id = y.entity_id")


def vectors(d: Spark, pairs: str) -> str:
    """Features of ``pairs``: rows ``c`` with the profiles ``x`` and ``y``."""
    z = lambda cond: f"CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    both = lambda c: f"{d.size('x.' + c)} > 0 AND {d.size('y.' + c)} > 0"
    meet = lambda c: f"{d.size(d.common('x.' + c, 'y.' + c))}"
    first = lambda t: f"coalesce({d.at(t + '.name_tokens', 1)}, '')"
    sj = sim.jaccard(d, "x.name_tokens", "y.name_tokens")
    base = {
        "name_exact": z("x.name <> '' AND x.name = y.name"),
        "name_sort_jaccard": sj,
        "name_tok_jaccard": sj,
        "name_dice_2g": sim.dice(d, "x.grams2", "y.grams2"),
        "name_char_jaccard": sim.jaccard(d, "x.grams3", "y.grams3"),
        "name_jw": sim.jaro_winkler(d, "x.name", "y.name"),
        "name_lev": sim.levenshtein_ratio(d, "x.name", "y.name"),
        "phonetic_match": z("x.sound1 <> '' AND x.sound1 = y.sound1"),
        "token_overlap_ratio": f"CASE WHEN {d.size('x.name_tokens')} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({meet('name_tokens')} AS DOUBLE) / {d.size(d.distinct('x.name_tokens'))} END",
        "name_len_diff": "CASE WHEN x.name = '' AND y.name = '' THEN CAST(0 AS DOUBLE) ELSE CAST(abs(length(x.name) - length(y.name)) AS DOUBLE) / greatest(length(x.name), length(y.name)) END",
        "num_match": f"CASE WHEN {both('digits')} THEN {z(meet('digits') + ' > 0')} ELSE CAST(0.5 AS DOUBLE) END",
        "house_num_mismatch_veto": z(f"{both('digits')} AND {meet('digits')} = 0"),
        "postal_match": f"CASE WHEN x.postal <> '' AND y.postal <> '' THEN {z('x.postal = y.postal')} ELSE CAST(0.5 AS DOUBLE) END",
        "postal_mismatch_veto": z("x.postal <> '' AND y.postal <> '' AND x.postal <> y.postal"),
        "addr_tok_jaccard": sim.jaccard(d, "x.addr_tokens", "y.addr_tokens"),
        "addr_char_jaccard": sim.jaccard(d, "x.addr3", "y.addr3"),
        "street_words_jaccard": sim.jaccard(d, "x.streets", "y.streets"),
        "addr_jw": sim.jaro_winkler(d, "x.addr", "y.addr"),
        "first_tok_match": z(f"{first('x')} <> '' AND {first('x')} = {first('y')}"),
        "first_tok_jw": f"CASE WHEN {first('x')} = '' OR {first('y')} = '' THEN CAST(0 AS DOUBLE) ELSE {sim.jaro_winkler(d, first('x'), first('y'))} END",
        "phone_match": f"CASE WHEN x.phone <> '' AND y.phone <> '' THEN {z('x.phone = y.phone')} ELSE CAST(0.5 AS DOUBLE) END",
        "code_match": z(meet("codes") + " > 0"),
        "is_s2": z("y.src = 'S2'"),
        "is_s3": z("y.src = 'S3'"),
        "rank_feat": "CAST(c.rank_no AS DOUBLE)",
        "acronym_match": z("(x.acronym <> '' AND x.acronym IN (y.name, y.acronym)) OR (y.acronym <> '' AND y.acronym IN (x.name, x.acronym))"),
        "lcp_ratio": sim.prefix_ratio(d, "x.name", "y.name"),
        "distinctiveness_score": "x.distinct_score",
        "single_word_containment": z(f"({d.size('x.name_tokens')} = 1 AND {d.has('y.name_tokens', 'x.name')}) OR ({d.size('y.name_tokens')} = 1 AND {d.has('x.name_tokens', 'y.name')})"),
        "shared_digits_count": f"least(CAST(1 AS DOUBLE), CAST({meet('digits')} AS DOUBLE) / 3)",
        "digit_transposition": sim.transposed(d, "x.digits", "y.digits"),
        "prefix_agreement": z("length(x.name) >= 4 AND length(y.name) >= 4 AND left(x.name, 4) = left(y.name, 4)"),
        "suffix_agreement": z("length(x.name) >= 4 AND length(y.name) >= 4 AND right(x.name, 4) = right(y.name, 4)"),
        "total_distinct_tokens": f"CAST({d.size(d.either('x.name_tokens', 'y.name_tokens'))} AS DOUBLE)",
    }
    inner = ", ".join(f"{v} AS {k}" for k, v in base.items())
    own = {
        "co_location_conflict": z("num_match = 1 AND name_sort_jaccard < 0.45 AND name_exact = 0 AND name_jw < 0.60"),
        "name_addr_interaction": "name_dice_2g * addr_char_jaccard",
        "name_jaro_addr_interaction": "name_jw * addr_jw",
        "distinctive_overlap": "token_overlap_ratio * distinctiveness_score",
    }
    outer = ", ".join(f"{d.round(own.get(k, k), 6)} AS {k}" for k in FEATURES)
    long_names = f"CASE WHEN {d.size('x.name_tokens')} >= 2 AND {d.size('y.name_tokens')} >= 2 THEN 1 ELSE 0 END AS long_names"
    return f"SELECT s1_id, cand_id, country, x_acronym, y_acronym, meet_digits, same_phone, same_name, long_names, {outer} FROM (SELECT c.s1_id, c.cand_id, c.country, x.acronym AS x_acronym, y.acronym AS y_acronym, {long_names}, CASE WHEN x.name = y.name THEN 1 ELSE 0 END AS same_name, {meet('digits')} AS meet_digits, CASE WHEN x.phone <> '' AND x.phone = y.phone THEN 1 ELSE 0 END AS same_phone, {inner} FROM {pairs}) AS f"


FEATURES = (
    "name_exact", "name_sort_jaccard", "name_tok_jaccard", "name_dice_2g", "name_char_jaccard", "name_jw", "name_lev", "phonetic_match", "token_overlap_ratio", "name_len_diff", "num_match", "house_num_mismatch_veto",
    "postal_match", "postal_mismatch_veto", "addr_tok_jaccard", "addr_char_jaccard", "street_words_jaccard", "addr_jw", "co_location_conflict", "first_tok_match", "first_tok_jw", "phone_match", "code_match", "is_s2", "is_s3",
    "rank_feat", "name_addr_interaction", "name_jaro_addr_interaction", "acronym_match", "lcp_ratio", "distinctiveness_score", "single_word_containment", "shared_digits_count", "digit_transposition", "prefix_agreement",
    "suffix_agreement", "total_distinct_tokens", "distinctive_overlap",
)


def gate(p: Profile) -> str:
    """Which pairs are hopeless, over their features."""
    anchor = "meet_digits > 0 OR code_match = 1 OR same_phone = 1"
    strict = "same_name = 0 AND name_sort_jaccard < 0.40 AND long_names = 1"
    region = f"CASE WHEN country IN ('France', 'US') THEN {strict} AND name_dice_2g < 0.35 WHEN country = 'India' THEN same_name = 0 AND name_sort_jaccard < 0.25 AND name_dice_2g < 0.22 AND NOT ({anchor}) ELSE FALSE END"
    return {"none": "FALSE", "strict": strict, "region": region}[p.gate]


def scored(d: Spark, p: Profile) -> str:
    """A fixed blend of features in place of a trained model, which operators.model supplies; the profile's gate sets hopeless pairs to 0."""
    blend = "0.35 * name_sort_jaccard + 0.20 * name_dice_2g + 0.15 * name_lev + 0.10 * num_match + 0.10 * addr_tok_jaccard + 0.10 * postal_match"
    return f"SELECT s1_id, cand_id, country, distinctiveness_score, CASE WHEN {gate(p)} THEN CAST(0 AS DOUBLE) ELSE {d.round(blend, 6)} END AS prob FROM @features"


def siblings(d: Spark, p: Profile) -> str:
    """(s1_id, cand_id, high, low) of targets of one record that agree with a target of its other source; ``high`` is the agreeing one's best probability.

    It doesn't depend on the threshold, so that a search of thresholds runs it once.
    """
    rule = p.sibling
    if rule is None:
        return "SELECT s1_id, cand_id, prob AS high, prob AS low FROM @scored WHERE 1 = 0"
    digits = f"{d.size(d.common('h.digits', 'l.digits'))} > 0"
    likeness = f"({sim.jaccard(d, 'h.name_tokens', 'l.name_tokens')})"
    acronym = "(h.acronym <> '' AND h.acronym = l.acronym)"
    agree = {
        "closure": f"(h.phone <> '' AND h.phone = l.phone) OR ({digits} AND ({likeness} >= 0.40 OR {sim.jaro_winkler(d, 'h.name', 'l.name')} >= 0.70 OR {acronym}))",
        "acronym": f"{digits} AND ({likeness} >= 0.45 OR {acronym})",
        "name": f"{digits} AND {likeness} >= 0.50",
        "loose": f"{digits} OR {d.size(d.common('h.name_tokens', 'l.name_tokens'))} >= 2",
    }[rule.agree]
    # Only pairs that can be raised meet: a doubtful target, and one that a threshold might call likely.
    side = lambda least, below: f"SELECT q.s1_id, q.cand_id, q.prob, r.src, r.phone, r.digits, r.name, r.name_tokens, r.acronym FROM @scored AS q JOIN @profiles AS r ON q.cand_id = r.entity_id WHERE q.prob >= {least} AND q.prob < {below}"
    high, top = rule.high or LOWEST, rule.high or HIGHEST
    both = f"({side(high, 2)}) AS h JOIN ({side(rule.low, top)}) AS l ON h.s1_id = l.s1_id AND h.src <> l.src AND l.prob < h.prob"
    return f"SELECT l.s1_id, l.cand_id, max(h.prob) AS high, max(l.prob) AS low FROM {both} WHERE {agree} GROUP BY l.s1_id, l.cand_id"


#: The thresholds tau that a search tries lie between these.
LOWEST, HIGHEST = 0.60, 0.72


def raised(p: Profile, tau: str) -> str:
    """A pair's probability after triangulation, over ``p`` (scored) and ``b`` (siblings, maybe none)."""
    if p.sibling is None:
        return "p.prob"
    high = p.sibling.high if p.sibling.high is not None else tau
    return f"CASE WHEN b.s1_id IS NOT NULL AND b.high >= {high} AND p.prob >= {p.sibling.low} AND p.prob < {high} THEN greatest(p.prob, round({tau} + {p.sibling.gain}, 6)) ELSE p.prob END"


def boosted(d: Spark, p: Profile) -> str:
    """Sibling triangulation: a likely target of one source raises a doubtful one of the other that agrees with it."""
    tau = f"CAST({p.tau} AS DOUBLE)"
    return f"SELECT p.s1_id, p.cand_id, p.country, p.distinctiveness_score, {raised(p, tau)} AS prob FROM @scored AS p LEFT JOIN @siblings AS b ON p.s1_id = b.s1_id AND p.cand_id = b.cand_id"


def claims(d: Spark, p: Profile) -> str:
    """Pairs over the record's own thresholds: its best must pass the shield, others come near the best."""
    if p.claims == "plain":
        return f"SELECT s1_id, cand_id, country, prob FROM @boosted WHERE prob >= {p.tau}"
    a, b = p.adapt
    return f"""SELECT s1_id, cand_id, country, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best, round({p.tau} + (0.5 - distinctiveness_score) * {a}, 9) AS t, round({p.tau_single} + (0.5 - distinctiveness_score) * {b}, 9) AS ts FROM @boosted) AS q
WHERE best >= ts AND prob >= t AND prob >= round(best - {p.margin}, 9)"""


def matches(d: Spark, p: Profile) -> str:
    """Every target goes to one record at most: the clear winner of its claims, or nobody."""
    if p.claims == "plain":
        return "SELECT s1_id, cand_id, prob FROM @claims"
    clear = f"AND (second IS NULL OR round(prob - second, 9) >= {p.delta})" if p.claims == "steal" else ""
    return f"SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY country, cand_id ORDER BY prob DESC, s1_id) AS rn, lead(prob) OVER (PARTITION BY country, cand_id ORDER BY prob DESC, s1_id) AS second FROM @claims) AS q WHERE rn = 1 {clear}"


def truth(d: Spark, p: Profile) -> str:
    return "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM @entities AS a JOIN @entities AS b ON a.truth_key = b.truth_key WHERE left(a.entity_id, 2) = 'S1' AND left(b.entity_id, 2) <> 'S1'"


def known(d: Spark, p: Profile) -> str:
    """The entities that have a truth key."""
    return "SELECT entity_id, truth_key FROM @entities WHERE truth_key IS NOT NULL"


def found(d: Spark, p: Profile) -> str:
    """The rows of ``truth`` that are candidates, by the keys of both sides: a group of copies isn't multiplied out."""
    return "SELECT x.entity_id AS s1_id, y.entity_id AS cand_id FROM (SELECT DISTINCT s1_id, cand_id FROM @candidates) AS c JOIN @known AS x ON c.s1_id = x.entity_id JOIN @known AS y ON c.cand_id = y.entity_id AND x.truth_key = y.truth_key WHERE left(x.entity_id, 2) = 'S1' AND left(y.entity_id, 2) <> 'S1'"


def true_pairs(d: Spark) -> str:
    """Where pairs that are all candidates look up whether they are true."""
    return "@found" if d.by_keys else "@truth"


def true_counts(d: Spark) -> str:
    """(s1_id, n): how many true matches each first-source record has."""
    if not d.by_keys:
        return "SELECT s1_id, count(*) AS n FROM @truth GROUP BY s1_id"
    return "SELECT a.entity_id AS s1_id, sum(b.n) AS n FROM @known AS a JOIN (SELECT truth_key, count(*) AS n FROM @known WHERE left(entity_id, 2) <> 'S1' GROUP BY truth_key) AS b ON a.truth_key = b.truth_key WHERE left(a.entity_id, 2) = 'S1' GROUP BY a.entity_id"


def results(d: Spark, p: Profile) -> str:
    """One row for each first-source record: its matches by id and its candidates by rank, empty ones too."""
    if d.name == "spark":
        ranked = "array_join(transform(array_sort(collect_list(struct(rank_no, cand_id))), x -> x.cand_id), ',')"
        ids = "array_join(array_sort(collect_set(cand_id)), ',')"
    else:
        ranked = "string_agg(cand_id, ',' ORDER BY rank_no)"
        ids = "string_agg(DISTINCT cand_id, ',' ORDER BY cand_id)"
    return f"SELECT e.entity_id AS source1_entity_id, coalesce(m.ids, '') AS matched_entity_ids, coalesce(c.ids, '') AS candidate_entity_ids FROM @entities AS e LEFT JOIN (SELECT s1_id, {ids} AS ids FROM @matches GROUP BY s1_id) AS m ON e.entity_id = m.s1_id LEFT JOIN (SELECT s1_id, {ranked} AS ids FROM @candidates GROUP BY s1_id) AS c ON e.entity_id = c.s1_id WHERE left(e.entity_id, 2) = 'S1'"


def entity_scores(d: Spark, p: Profile) -> str:
    """F0.5 of each first-source record: 1 where nothing is to be found and nothing is, else 0 without a hit."""
    right, found = "(h.n * CAST(1 AS DOUBLE) / m.n)", "(h.n * CAST(1 AS DOUBLE) / t.n)"
    f05 = d.round(f"1.25 * {right} * {found} / (0.25 * {right} + {found})", 6)
    return f"""SELECT e.entity_id AS s1_id, coalesce(t.n, 0) AS n_true, coalesce(m.n, 0) AS n_pred, coalesce(h.n, 0) AS n_hit,
  CASE WHEN t.n IS NULL AND m.n IS NULL THEN CAST(1 AS DOUBLE) WHEN h.n IS NULL THEN CAST(0 AS DOUBLE)
    ELSE {f05} END AS f05
FROM @entities AS e LEFT JOIN ({true_counts(d)}) AS t ON e.entity_id = t.s1_id
LEFT JOIN (SELECT s1_id, count(*) AS n FROM @matches GROUP BY s1_id) AS m ON e.entity_id = m.s1_id
LEFT JOIN (SELECT m.s1_id, count(*) AS n FROM @matches AS m JOIN {true_pairs(d)} AS t ON m.s1_id = t.s1_id AND m.cand_id = t.cand_id GROUP BY m.s1_id) AS h ON e.entity_id = h.s1_id
WHERE left(e.entity_id, 2) = 'S1'"""


def evaluation(d: Spark, p: Profile) -> str:
    """Macro F0.5 (0 without records), the blocker's recall, collisions, shares, averages, and how many candidates are right."""
    return f"""SELECT round(coalesce(avg(f05), CAST(0 AS DOUBLE)), 6) AS macro_f05, count(*) AS n_entities, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_hit) AS BIGINT) AS n_hit,
  round(avg(CASE WHEN n_pred = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS singleton_share, round(avg(CAST(n_pred AS DOUBLE)), 6) AS avg_matches,
  (SELECT count(*) FROM {true_pairs(d)} AS t JOIN @candidates AS c ON t.s1_id = c.s1_id AND t.cand_id = c.cand_id) AS n_retrieved,
  (SELECT count(*) FROM @candidates) - (SELECT count(*) FROM {true_pairs(d)} AS t JOIN @candidates AS c ON t.s1_id = c.s1_id AND t.cand_id = c.cand_id) AS n_wrong_candidates,
  (SELECT count(*) FROM (SELECT cand_id FROM @matches GROUP BY cand_id HAVING count(*) > 1) AS z) AS n_collisions FROM @entity_scores"""


def stopwords(d: Spark, p: Profile) -> str:
    """Address words that at least 3 in 100 records of a country have."""
    words = d.distinct(d.all("lower(business_address)", "[a-z]{3,}"))
    inner = f"SELECT country, word FROM @entities {d.explode(words, 'word')}" if d.name == "spark" else f"SELECT country, unnest({words}) AS word FROM @entities"
    return f"SELECT w.country, w.word, w.n, {d.round('w.n * CAST(1 AS DOUBLE) / c.total', 6)} AS share FROM (SELECT country, word, count(*) AS n FROM ({inner}) AS i GROUP BY country, word) AS w JOIN (SELECT country, count(*) AS total FROM @entities GROUP BY country) AS c ON w.country = c.country WHERE w.n >= 0.03 * c.total"


#: Thresholds that a search tries, in this order: of a match, of a record's best, the distance from the best, the lead over other claims.
GRID = tuple((t, s, m, a) for t in (0.65, 0.68, 0.70, 0.72) for s in (0.74, 0.76, 0.78, 0.80) for m in (0.14, 0.16, 0.18) for a in (0.03, 0.05, 0.07) if s >= t)


def grid(d: Spark, p: Profile) -> str:
    """Macro F0.5 of the whole decision for every setting of GRID, all in one pass: triangulation, thresholds, exclusive claims, scores.

    Pairs are multiplied by a list of fixed length. A record without a true match and without a prediction scores 1.
    """
    rows = ", ".join(f"({i}, {t}, {s}, {m}, {a})" for i, (t, s, m, a) in enumerate(GRID))
    taus = ", ".join(f"({t})" for t in sorted({g[0] for g in GRID}))
    one, double = "CAST(1 AS DOUBLE)", lambda c: f"CAST({c} AS DOUBLE) AS {c}"
    levels = f"(SELECT {double('tau')} FROM (VALUES {taus}) AS v(tau)) AS g"
    values = f"(SELECT CAST(nr AS INT) AS nr, {double('tau')}, {double('tau_single')}, {double('margin')}, {double('delta')} FROM (VALUES {rows}) AS v(nr, tau, tau_single, margin, delta))"
    lifted = f"SELECT g.tau, p.s1_id, p.cand_id, p.country, {raised(p, 'g.tau')} AS prob FROM @scored AS p LEFT JOIN @siblings AS b ON p.s1_id = b.s1_id AND p.cand_id = b.cand_id JOIN {levels} ON p.prob >= {p.sibling.low if p.sibling else 0}"
    claimed = f"SELECT g.nr, g.delta, q.s1_id, q.cand_id, q.country, q.prob FROM (SELECT l.*, max(prob) OVER (PARTITION BY tau, s1_id) AS best FROM ({lifted}) AS l) AS q JOIN {values} AS g ON q.tau = g.tau AND q.prob >= g.tau AND q.best >= g.tau_single AND q.prob >= round(q.best - g.margin, 9)"
    won = f"SELECT nr, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY nr, country, cand_id ORDER BY prob DESC, s1_id) AS rn, lead(prob) OVER (PARTITION BY nr, country, cand_id ORDER BY prob DESC, s1_id) AS second FROM ({claimed}) AS c) AS w WHERE rn = 1 AND (second IS NULL OR round(prob - second, 9) >= delta)"
    per = f"SELECT w.nr, w.s1_id, count(*) AS n_pred, count(t.s1_id) AS n_hit FROM ({won}) AS w LEFT JOIN {true_pairs(d)} AS t ON w.s1_id = t.s1_id AND w.cand_id = t.cand_id GROUP BY w.nr, w.s1_id"
    right, found = f"(x.n_hit * {one} / x.n_pred)", f"(x.n_hit * {one} / e.n_true)"
    f05 = f"CASE WHEN x.n_hit = 0 THEN CAST(0 AS DOUBLE) ELSE {d.round(f"1.25 * {right} * {found} / (0.25 * {right} + {found})", 6)} END"
    scores = f"SELECT x.nr, CAST(sum(x.n_pred) AS BIGINT) AS n_pred, CAST(sum(x.n_hit) AS BIGINT) AS n_hit, sum({f05}) AS total, CAST(sum(CASE WHEN e.n_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM ({per}) AS x JOIN @entity_scores AS e ON x.s1_id = e.s1_id GROUP BY x.nr"
    # Records without predictions score 1 if they have no true match: all of those but the ones with a wrong prediction.
    return f"""SELECT g.nr, g.tau, g.tau_single, g.margin, g.delta, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit, round((coalesce(total, CAST(0 AS DOUBLE)) + k.alone - coalesce(wrong, 0)) / greatest(k.n, 1), 6) AS macro_f05
FROM {values} AS g LEFT JOIN ({scores}) AS r ON g.nr = r.nr JOIN (SELECT count(*) AS n, count(CASE WHEN n_true = 0 THEN 1 END) AS alone FROM @entity_scores) AS k ON 1 = 1"""


def best_setting(d: Spark, p: Profile) -> str:
    """The setting of the highest macro F0.5, the first of equals."""
    return "SELECT tau, tau_single, margin, delta, macro_f05 FROM @grid ORDER BY macro_f05 DESC, nr LIMIT 1"


def folds(d: Spark, p: Profile) -> str:
    """(s1_id, stratum, fold): records dealt to five folds evenly within each number of true matches, in parts of a hash, so that none is ordered as a whole."""
    part = "conv(left(md5(s1_id), 2), 16, 10)" if d.name == "spark" else "concat('0x', left(md5(s1_id), 2))"
    return f"""SELECT s1_id, stratum, CAST((row_number() OVER (PARTITION BY stratum, part ORDER BY md5(s1_id), s1_id) + part) % 5 AS INT) AS fold
FROM (SELECT s1_id, least(n_true, 4) AS stratum, CAST({part} AS INT) AS part FROM @entity_scores) AS x"""


def fold_scores(d: Spark, p: Profile) -> str:
    """Mean and population deviation of the folds' macro F0.5."""
    return "SELECT count(*) AS n_folds, round(avg(f05), 6) AS mean_f05, round(stddev_pop(f05), 6) AS std_f05 FROM (SELECT f.fold, avg(e.f05) AS f05 FROM @folds AS f JOIN @entity_scores AS e ON f.s1_id = e.s1_id GROUP BY f.fold) AS x"


def offenders(d: Spark, p: Profile) -> str:
    """(finding, entity_id, detail) of everything wrong with the results: repeated rows and ids, own or foreign prefixes, unknown ids, matches that were no candidates, missing and unexpected rows."""
    split = lambda c: d.keep(f"split({c}, ',')" if d.name == "spark" else f"string_split({c}, ',')", "v", "v <> ''")
    ids, cands = split("matched_entity_ids"), split("candidate_entity_ids")
    key = "source1_entity_id AS entity_id"
    each = "SELECT source1_entity_id, v FROM @results LATERAL VIEW explode(" + ids + ") AS v" if d.name == "spark" else "SELECT source1_entity_id, unnest(" + ids + ") AS v FROM @results"
    diff = d.keep(ids, "v", f"NOT {d.has(cands, 'v')}")
    rows = {
        "duplicate_rows": "SELECT source1_entity_id AS entity_id, '' AS detail FROM @results GROUP BY source1_entity_id HAVING count(*) > 1",
        "duplicate_ids": f"SELECT {key}, '' AS detail FROM @results WHERE {d.size(ids)} <> {d.size(d.distinct(ids))}",
        "self_matches": f"SELECT {key}, {d.join(d.keep(ids, 'v', d.like('v', '^S1-')), ',')} AS detail FROM @results WHERE {d.any(ids, 'v', d.like('v', '^S1-'))}",
        "wrong_prefix": f"SELECT {key}, {d.join(d.keep(ids, 'v', 'NOT ' + d.like('v', '^S[23]-')), ',')} AS detail FROM @results WHERE {d.any(ids, 'v', 'NOT ' + d.like('v', '^S[23]-'))}",
        "not_candidates": f"SELECT {key}, {d.join(diff, ',')} AS detail FROM @results WHERE {d.size(diff)} > 0",
        "missing_rows": "SELECT entity_id, '' AS detail FROM (SELECT entity_id FROM @entities WHERE left(entity_id, 2) = 'S1' EXCEPT SELECT source1_entity_id AS entity_id FROM @results) AS z",
        "unexpected_rows": "SELECT entity_id, '' AS detail FROM (SELECT source1_entity_id AS entity_id FROM @results EXCEPT SELECT entity_id FROM @entities WHERE left(entity_id, 2) = 'S1') AS z",
        "unknown_ids": f"SELECT i.source1_entity_id AS entity_id, i.v AS detail FROM ({each}) AS i LEFT JOIN @entities AS e ON i.v = e.entity_id WHERE e.entity_id IS NULL",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS finding, entity_id, detail FROM ({q}) AS o_{k}" for k, q in rows.items())


FINDINGS = ("duplicate_rows", "duplicate_ids", "self_matches", "wrong_prefix", "not_candidates", "missing_rows", "unexpected_rows", "unknown_ids")


def checks(d: Spark, p: Profile) -> str:
    """How often each finding occurs, none too; matches that were no candidates are warnings, all else errors."""
    names = ", ".join(f"('{k}')" for k in FINDINGS)
    return f"SELECT f.finding, CASE WHEN f.finding = 'not_candidates' THEN 'warning' ELSE 'error' END AS kind, count(o.finding) AS n FROM (VALUES {names}) AS f(finding) LEFT JOIN @offenders AS o ON f.finding = o.finding GROUP BY f.finding"


def first_offenders(d: Spark, p: Profile) -> str:
    """The first five offenders of each finding, by id."""
    return "SELECT finding, entity_id, detail FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY entity_id, detail) AS rn FROM @offenders) AS o WHERE rn <= 5"


def verdict(d: Spark, p: Profile) -> str:
    """Rows, errors, warnings, and whether the results pass: exit code 0 without errors, else 1."""
    return """SELECT (SELECT count(*) FROM @results) AS n_rows, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, CASE WHEN errors = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN errors = 0 THEN 0 ELSE 1 END AS exit_code
FROM (SELECT sum(CASE WHEN kind = 'error' THEN n ELSE 0 END) AS errors, sum(CASE WHEN kind = 'warning' THEN n ELSE 0 END) AS warnings FROM @checks) AS c"""


def legacy_records(d: Spark, p: Profile) -> str:
    """What earlier generations' normalisers make of each entity."""
    low = lg.plain(d, "business_address")
    return f"""SELECT entity_id, {lg.name_without_cities(d, "business_name")} AS name_v1, {lg.name_ascii(d, "business_name")} AS name_ascii, {lg.long_tokens(d, lg.name_ascii(d, "business_name"))} AS long_tokens,
  {lg.address_expanded(d, "business_address")} AS addr_v1, {lg.street_words(d, low)} AS streets_v21, {lg.care_of(d, "business_address")} AS care_of, {lg.last_six_digits(d, "business_address")} AS postal_v1
FROM @entities"""


def legacy_features(d: Spark, p: Profile) -> str:
    """Pair features that only earlier vectors have."""
    own = ", ".join(f"{v} AS {k}" for k, v in lg.features(d).items())
    return f"SELECT c.s1_id, c.cand_id, {own} FROM @candidates AS c JOIN @profiles AS x ON c.s1_id = x.entity_id JOIN @profiles AS y ON c.cand_id = y.entity_id"


def _vector(generation: str) -> Callable[[Spark, Profile], str]:
    def vector(d: Spark, p: Profile) -> str:
        own = lg.variants(d, generation)
        columns = ", ".join(f"{d.round(own[k], 6)} AS {k}" if k in own else f"{'f' if k in FEATURES else 'l'}.{k}" for k in lg.VECTORS[generation])
        return f"SELECT f.s1_id, f.cand_id, {columns} FROM @features AS f JOIN @legacy_features AS l ON f.s1_id = l.s1_id AND f.cand_id = l.cand_id JOIN @profiles AS x ON f.s1_id = x.entity_id JOIN @profiles AS y ON f.cand_id = y.entity_id"

    vector.__name__, vector.__doc__ = f"vector_{generation}", "An earlier generation's vector, its columns in order."
    return vector


def needed_records(d: Spark, p: Profile) -> str:
    """The first-source records that the truth names."""
    return f"SELECT entity_id, name, addr FROM @records WHERE src = 'S1' AND entity_id IN (SELECT s1_id FROM @truth)"


def hard_negatives(d: Spark, p: Profile) -> str:
    """Targets for training: true matches, and those that share a whole name, or else its first two words, with a first-source record."""
    own = "ch IN ('ex', 'bi_sort')"
    return f"""SELECT cand_id AS entity_id FROM @truth
UNION SELECT t.entity_id FROM @keys AS t JOIN (SELECT DISTINCT country, ch, val FROM @keys WHERE src = 'S1' AND {own}) AS s ON t.country = s.country AND t.ch = s.ch AND t.val = s.val WHERE t.src <> 'S1' AND t.{own}"""


def background_negatives(d: Spark, p: Profile) -> str:
    """The first 20,000 targets of each source by id, and all true matches."""
    first = lambda src: f"SELECT entity_id FROM (SELECT entity_id FROM @entities WHERE left(entity_id, 2) = '{src}' ORDER BY entity_id LIMIT 20000) AS {src.lower()}"
    return f"{first('S2')} UNION {first('S3')} UNION SELECT cand_id AS entity_id FROM @truth"


#: A group of copies is multiplied out in blocks of about so many records by so many targets.
BLOCK = 1000


def places(d: Spark, p: Profile) -> str:
    """The targets that have a truth key, each with its place by id among those of its key."""
    return "SELECT entity_id, truth_key, row_number() OVER (PARTITION BY truth_key ORDER BY entity_id) AS place FROM @known WHERE left(entity_id, 2) <> 'S1'"


def seekers(d: Spark, p: Profile) -> str:
    """First-source records that have a truth key, whose id is in one row only: their last rank, and the places of their true candidates."""
    single = "SELECT entity_id, max(country) AS country, max(truth_key) AS truth_key FROM @entities WHERE left(entity_id, 2) = 'S1' GROUP BY entity_id HAVING count(*) = 1 AND max(truth_key) IS NOT NULL"
    hits = "SELECT f.s1_id, collect_set(y.place) AS hits FROM @found AS f JOIN @known AS x ON f.s1_id = x.entity_id JOIN @places AS y ON f.cand_id = y.entity_id AND x.truth_key = y.truth_key GROUP BY f.s1_id"
    last = "SELECT s1_id, max(rank_no) AS last_rank FROM @candidates GROUP BY s1_id"
    return f"SELECT e.entity_id, e.country, e.truth_key, coalesce(l.last_rank, -1) AS last_rank, coalesce(h.hits, CAST(array() AS array<int>)) AS hits FROM ({single}) AS e LEFT JOIN ({hits}) AS h ON e.entity_id = h.s1_id LEFT JOIN ({last}) AS l ON e.entity_id = l.s1_id"


def training_by_keys(d: Spark) -> str:
    """``training_pairs`` of Spark: a missed pair's rank follows from its target's place, so that no pair is shuffled, sorted or looked up.

    Records whose id is in several rows, maybe of several keys, are ranked pair by pair.
    """
    labelled = "SELECT c.s1_id, c.cand_id, c.country, c.score, c.rank_no, CAST(CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS INT) AS label FROM @candidates AS c LEFT JOIN @found AS t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id"
    missed = f"SELECT x.entity_id AS s1_id, y.entity_id AS cand_id, x.country, CAST(0 AS DOUBLE) AS score, {MISSED_RANK} AS rank_no, 1 AS label FROM {blocked(d, '@seekers', '@places', 'entity_id', 'place')} WHERE {MISSED}"
    return f"{labelled} UNION ALL {missed} UNION ALL {missed_of_several()}"


#: Of a seeker and a target of its key: whether it was missed, and its rank, after the last candidate by its place among the missed ones.
MISSED, MISSED_RANK = "NOT array_contains(x.hits, y.place)", "x.last_rank + y.place - size(filter(x.hits, v -> v < y.place))"


def blocked(d: Spark, own: str, other: str, by: str, at: str, block: int = BLOCK) -> str:
    """Rows of ``own`` (``x``) with those of ``other`` (``y``) of the same truth key, in blocks told by a column of each."""
    blocks = f"SELECT a.truth_key, CAST(ceil(a.n / {block}) AS INT) AS own, CAST(ceil(b.n / {block}) AS INT) AS other FROM (SELECT truth_key, count(*) AS n FROM {own} GROUP BY truth_key) AS a JOIN (SELECT truth_key, count(*) AS n FROM {other} GROUP BY truth_key) AS b ON a.truth_key = b.truth_key"
    left = f"SELECT /*+ REPARTITION({d.parts}, truth_key, i, j) */ s.*, CAST(pmod(xxhash64(s.{by}), k.own) AS INT) AS i, j FROM {own} AS s JOIN ({blocks}) AS k ON s.truth_key = k.truth_key LATERAL VIEW explode(sequence(0, k.other - 1)) AS j"
    right = f"SELECT y.*, i, CAST(pmod(y.{at}, k.other) AS INT) AS j FROM {other} AS y JOIN ({blocks}) AS k ON y.truth_key = k.truth_key LATERAL VIEW explode(sequence(0, k.own - 1)) AS i"
    return f"({left}) AS x JOIN ({right}) AS y ON x.truth_key = y.truth_key AND x.i = y.i AND x.j = y.j"


def missed_of_several() -> str:
    """Missed pairs of records whose id is in several rows, pair by pair."""
    several = "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM @known AS a JOIN @places AS b ON a.truth_key = b.truth_key WHERE a.entity_id IN (SELECT entity_id FROM @entities WHERE left(entity_id, 2) = 'S1' GROUP BY entity_id HAVING count(*) > 1)"
    return f"""SELECT t.s1_id, t.cand_id, e.country, CAST(0 AS DOUBLE) AS score, coalesce(l.last_rank, -1) + row_number() OVER (PARTITION BY t.s1_id ORDER BY t.cand_id) AS rank_no, 1 AS label
FROM ({several}) AS t JOIN @entities AS e ON t.s1_id = e.entity_id LEFT JOIN @candidates AS c ON t.s1_id = c.s1_id AND t.cand_id = c.cand_id
LEFT JOIN (SELECT s1_id, max(rank_no) AS last_rank FROM @candidates GROUP BY s1_id) AS l ON t.s1_id = l.s1_id WHERE c.s1_id IS NULL"""


#: Records with a truth key that agree in these have one look: the same key, and the same features with any record, but for a target's source.
LOOK = ("truth_key", "name", "addr", "digits", "codes", "postal", "phone")
SEEN = ("name", "name_tokens", "addr", "addr_tokens", "digits", "codes", "postal", "phone", "acronym", "distinct_score", "sound1", "sound2", "grams2", "grams3", "addr3", "streets")
#: Pairs of looks have their features computed in blocks of about so many by so many.
LOOK_BLOCK = 200


def looked(columns: str) -> str:
    return f"SELECT {columns}, md5(to_json(struct({', '.join(LOOK)}))) AS mark FROM @profiles WHERE truth_key IS NOT NULL"


def look_profiles(d: Spark, p: Profile) -> str:
    """The profile of each look, under a number."""
    return f"SELECT monotonically_increasing_id() AS look, mark, v.* FROM (SELECT mark, any_value(struct({', '.join(('truth_key', *SEEN))})) AS v FROM ({looked('*')}) AS r GROUP BY mark) AS g"


def looks(d: Spark, p: Profile) -> str:
    """(entity_id, src, truth_key, look) of the records that have a truth key."""
    return f"SELECT r.entity_id, r.src, r.truth_key, l.look FROM ({looked('entity_id, src, truth_key')}) AS r JOIN @look_profiles AS l ON r.mark = l.mark"


def look_seekers(d: Spark, p: Profile) -> str:
    """Seekers of one look that have the same candidates to skip, counted."""
    return "SELECT truth_key, look, last_rank, hits, count(*) AS n FROM (SELECT s.truth_key, k.look, s.last_rank, array_sort(s.hits) AS hits FROM @seekers AS s JOIN @looks AS k ON s.entity_id = k.entity_id) AS q GROUP BY truth_key, look, last_rank, hits"


def look_places(d: Spark, p: Profile) -> str:
    return "SELECT p.truth_key, p.place, k.src, k.look FROM @places AS p JOIN @looks AS k ON p.entity_id = k.entity_id AND p.truth_key = k.truth_key"


def look_pairs(d: Spark, p: Profile) -> str:
    """Looks of first-source records with looks of targets of the same truth key, and both profiles."""
    side = lambda cond: f"(SELECT l.* FROM @look_profiles AS l LEFT SEMI JOIN (SELECT look FROM @looks WHERE {cond}) AS k ON l.look = k.look)"
    shown = lambda t: f"struct({', '.join(f'{t}.{c}' for c in SEEN)}, '' AS src)"
    own, other = side("src = 'S1'"), side("src <> 'S1'")
    return f"SELECT x.look AS s1_id, y.look AS cand_id, '' AS country, 0 AS rank_no, {shown('x')} AS x, {shown('y')} AS y FROM {blocked(d, own, other, 'look', 'look', LOOK_BLOCK)}"


def look_features(d: Spark, p: Profile) -> str:
    return vectors(d, "@look_pairs AS c")


def missed_looks(d: Spark, p: Profile) -> str:
    """(x, y, src, rank_no, n): the missed pairs of ``training_pairs`` counted by looks; ranks from 32 on by their first four binary digits, as no candidate has them."""
    rank = "CASE WHEN r < 32 THEN r ELSE shiftleft(shiftright(r, length(bin(r)) - 4), length(bin(r)) - 4) END"
    rest = f"SELECT a.look AS x, b.look AS y, b.src, CAST(t.rank_no AS BIGINT) AS r, 1 AS n FROM ({missed_of_several()}) AS t JOIN @looks AS a ON t.s1_id = a.entity_id JOIN @looks AS b ON t.cand_id = b.entity_id AND a.truth_key = b.truth_key"
    most = f"SELECT x.look AS x, y.look AS y, y.src, CAST({MISSED_RANK} AS BIGINT) AS r, x.n FROM {blocked(d, '@look_seekers', '@look_places', 'look', 'place')} WHERE {MISSED}"
    return f"SELECT x, y, src, rank_no, sum(n) AS n FROM (SELECT x, y, src, {rank} AS rank_no, n FROM ({most} UNION ALL {rest}) AS u) AS g GROUP BY x, y, src, rank_no"


def training_pairs(d: Spark, p: Profile) -> str:
    """Candidates with labels, and the true pairs that retrieval missed, ranked after them; for training only."""
    if d.by_keys:
        return training_by_keys(d)
    return """SELECT c.s1_id, c.cand_id, c.country, c.score, c.rank_no, CAST(CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS INT) AS label FROM @candidates AS c LEFT JOIN @truth AS t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id
UNION ALL SELECT t.s1_id, t.cand_id, e.country, CAST(0 AS DOUBLE) AS score, coalesce(l.last_rank, -1) + row_number() OVER (PARTITION BY t.s1_id ORDER BY t.cand_id) AS rank_no, 1 AS label
FROM @truth AS t JOIN @entities AS e ON t.s1_id = e.entity_id LEFT JOIN @candidates AS c ON t.s1_id = c.s1_id AND t.cand_id = c.cand_id
LEFT JOIN (SELECT s1_id, max(rank_no) AS last_rank FROM @candidates GROUP BY s1_id) AS l ON t.s1_id = l.s1_id WHERE c.s1_id IS NULL"""


STEPS = {f.__name__: f for f in (entities, head_sample, stopwords, records, profiles, keys, weights, candidates, features, scored, siblings, boosted, claims, matches, truth, results, entity_scores, evaluation, grid, best_setting, folds, fold_scores, offenders, checks, first_offenders, verdict, legacy_records, legacy_features, *map(_vector, lg.VECTORS), needed_records, hard_negatives, background_negatives, training_pairs)}
#: Steps that only Spark's plans have.
HELPERS = {f.__name__: f for f in (known, found, places, seekers, look_profiles, looks, look_seekers, look_places, look_pairs, look_features, missed_looks)}
#: Steps that several others use and that cost a join or Python: they are written once and read again.
SHARED = ("entities", "profiles", "keys", "candidates", "features", "matches", "siblings", "truth", "known", "found", "places", "seekers", "entity_scores", "offenders", "look_profiles", "looks", "look_seekers", "look_places", "missed_looks")


class Plan:
    """The steps over one set of tables, as DataFrames; shared ones are staged on first use by a later step."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], profile: Profile = V30, stage: bool = True) -> None:
        from ..functions.similarity import register

        register(spark)
        self.spark, self.frames, self.profile, self.stage = spark, dict(tables), profile, stage

    def step(self, name: str, last: bool = True) -> DataFrame:
        if name not in self.frames:
            # A truth that is given, or already there, is the one that counts.
            statement = (STEPS | HELPERS)[name](Spark("truth" not in self.frames, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))), self.profile)
            inputs = {m: self.step(m, last=False) for m in dict.fromkeys(re.findall(r"@(\w+)", statement))}
            body = re.sub(r"@(\w+)", r"{\1}", statement.replace("{", "{{").replace("}", "}}"))
            frame = self.spark.sql(body, **inputs)
            if last:
                return frame
            if self.stage and name in SHARED:
                from ..sources.staging import staged

                frame = staged(frame, name)
            self.frames[name] = frame
        return self.frames[name]


def duckdb_sql(name: str, profile: Profile = V30) -> str:
    """A step with all it needs as common table expressions."""
    order: list[str] = []

    def visit(step: str) -> None:
        if step in STEPS and step not in order:
            for other in re.findall(r"@(\w+)", STEPS[step](DuckDB(), profile)):
                visit(other)
            order.append(step)

    visit(name)
    parts = [f"{s} AS MATERIALIZED ({re.sub(r'@(\w+)', r'\1', STEPS[s](DuckDB(), profile))})" for s in order]
    return f"WITH {', '.join(parts)} SELECT * FROM {name}"
