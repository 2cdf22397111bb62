"""Normalisers of earlier generations that the default rules replaced, as SQL expressions."""

from __future__ import annotations

from .dialect import ACCENTED, PLAIN, Spark
from .similarity import jaccard, prefix_ratio
from .text import MARKS, STREET_WORDS, SUFFIXES, own_words, tokens, without_notes

# Abbreviations of addresses and what they stand for, and city names that a French name may hold.
EXPANDED = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "pkwy": "parkway", "hwy": "highway",
    "apt": "apartment", "ste": "suite", "fl": "floor", "bldg": "building", "dept": "department", "no": "number", "sec": "sector", "po": "post",
    "bd": "boulevard", "av": "avenue", "che": "chemin", "imp": "impasse", "all": "allee", "r": "rue",
}
CITIES = ("paris", "lyon", "marseille", "bordeaux", "nantes", "toulouse", "lille", "nice", "strasbourg", "rennes", "montpellier")
#: Abbreviations that Indian addresses don't have.
FRENCH = ("bd", "av", "che", "imp", "all", "r")
#: The first generation's legal forms lack one of the later ones.
FIRST_SUFFIXES = tuple(s for s in SUFFIXES if s != "partners")


def plain(d: Spark, s: str) -> str:
    return f"translate(lower(coalesce({s}, '')), {d.text(ACCENTED)}, {d.text(PLAIN)})"


def name_without_cities(d: Spark, s: str) -> str:
    """A name without notes, legal forms and, if it has several words and some remain, without city names."""
    words = tokens(d, d.sub(without_notes(d, plain(d, s)), MARKS, " "))
    own = d.keep(words, "t", f"NOT {d.has(d.strings(FIRST_SUFFIXES), 't')}")
    rest = d.keep(own, "t", f"NOT {d.has(d.strings(CITIES), 't')}")
    return f"CASE WHEN {d.size(own)} > 1 AND {d.size(rest)} > 0 THEN {d.join(rest, ' ')} WHEN {d.size(own)} > 0 THEN {d.join(own, ' ')} ELSE {d.join(words, ' ')} END"


def name_ascii(d: Spark, s: str) -> str:
    """An Indian name: decomposed by compatibility, ASCII words only, without notes and legal forms; all words if none is left."""
    low = d.unmarked(f"coalesce({s}, '')", "NFKD")
    return own_words(d, tokens(d, d.sub(without_notes(d, low), "[^a-z0-9]+", " ")), d.strings(SUFFIXES))


def address_ascii(d: Spark, s: str) -> str:
    """An Indian address: ASCII words with abbreviations written out."""
    words = tokens(d, d.sub(d.unmarked(f"coalesce({s}, '')", "NFKD"), "[^a-z0-9]+", " "))
    value = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPANDED.items() if k not in FRENCH) + " ELSE t END"
    return d.join(d.each(words, "t", value), " ")


def long_tokens(d: Spark, name: str) -> str:
    """Tokens of a clean name of more than one character."""
    return d.keep(tokens(d, name), "t", "length(t) > 1")


def address_expanded(d: Spark, s: str) -> str:
    """An address with its slashes and hyphens kept and abbreviations written out."""
    words = tokens(d, d.sub(plain(d, s), r"[^\p{L}\p{N}_/\s-]+", " "))
    value = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPANDED.items()) + " ELSE t END"
    return d.join(d.each(words, "t", value), " ")


def street_words(d: Spark, addr: str) -> str:
    return d.keep(d.all(addr, "[a-z]+"), "t", f"length(t) >= 3 AND NOT {d.has(d.strings(STREET_WORDS), 't')}")


def care_of(d: Spark, s: str) -> str:
    """The first two words of four letters or more after the last c/o."""
    whole = f"replace({plain(d, s)}, 'care of', 'c/o')"
    last = f"regexp_replace({whole}, '^.*c/o', '')"
    words = d.keep(d.all(last, "[a-z]+"), "t", f"length(t) >= 4 AND NOT {d.has(d.strings(STREET_WORDS), 't')}")
    return f"CASE WHEN {whole} LIKE '%c/o%' THEN {d.first(words, 2)} ELSE {d.empty} END"


def last_six_digits(d: Spark, s: str) -> str:
    return f"coalesce({d.at(d.all(s, r'\b[0-9]{6}\b'), -1)}, '')"


# The order of each earlier vector. Names that a later vector redefines carry their own rule below.
VECTORS = {
    "v20": ("name_exact", "name_containment", "name_tok_jaccard", "name_char_jaccard", "name_prefix", "name_len_diff", "num_match", "postal_match", "addr_tok_jaccard", "addr_char_jaccard", "pure_address_match", "has_non_ascii", "domain_stem_match", "code_match", "is_s2", "is_s3", "rank_feat", "name_addr_interaction", "postal_mismatch_veto", "house_num_mismatch_veto"),
    "v21": ("name_exact", "name_containment", "name_tok_jaccard", "name_char_jaccard", "name_prefix", "name_len_diff", "num_match", "postal_match", "addr_tok_jaccard", "addr_char_jaccard", "pure_address_match", "has_non_ascii", "domain_stem_match", "code_match", "is_s2", "is_s3", "rank_feat", "name_addr_interaction", "postal_mismatch_veto", "house_num_mismatch_veto", "token_overlap_ratio", "street_words_jaccard", "first_tok_match", "name_dice_2g", "phone_match"),
    "v22": ("name_exact", "name_sort_jaccard", "name_tok_jaccard", "name_dice_2g", "name_char_jaccard", "token_overlap_ratio", "name_len_diff", "num_match", "postal_match", "addr_tok_jaccard", "addr_char_jaccard", "street_words_jaccard", "co_location_conflict", "house_num_mismatch_veto", "postal_mismatch_veto", "first_tok_match", "phone_match", "code_match", "is_s2", "is_s3", "rank_feat", "name_addr_interaction"),
    "v23": ("name_exact", "name_sort_jaccard", "name_tok_jaccard", "name_dice_2g", "name_char_jaccard", "token_overlap_ratio", "name_len_diff", "num_match", "postal_match", "addr_tok_jaccard", "addr_char_jaccard", "street_words_jaccard", "co_location_conflict", "house_num_mismatch_veto", "postal_mismatch_veto", "first_tok_match", "phone_match", "code_match", "is_s2", "is_s3", "rank_feat", "name_addr_interaction", "acronym_match", "lcp_ratio", "distinctiveness_score"),
    "india": ("name_exact", "name_containment", "name_tok_jaccard", "name_char_jaccard", "name_prefix", "name_len_diff", "num_match", "postal_match", "addr_tok_jaccard", "addr_char_jaccard", "is_s2", "is_s3", "rank_feat", "name_addr_interaction"),
}


#: Pair features of earlier vectors, over a pair of records x and y.
def features(d: Spark) -> dict[str, str]:
    z = lambda cond: f"CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    has = lambda a, b: f"({b} <> '' AND instr({a}, {b}) > 0)"
    merged = d.join("y.name_tokens", "")
    return {
        "name_containment": z(f"x.name <> '' AND y.name <> '' AND ({has('x.name', 'y.name')} OR {has('y.name', 'x.name')})"),
        "name_prefix": prefix_ratio(d, "x.name", "y.name"),
        "pure_address_match": z(f"{d.size(d.common('x.digits', 'y.digits'))} > 0 AND {jaccard(d, 'x.addr_tokens', 'y.addr_tokens')} >= 0.65"),
        "has_non_ascii": z(d.like("y.name", "[^\\x00-\\x7F]")),
        "domain_stem_match": z(d.any("x.name_tokens", "t", f"length(t) >= 4 AND instr({merged}, t) > 0")),
    }


def variants(d: Spark, generation: str) -> dict[str, str]:
    """Features under a later name that a generation computes by a rule of its own, over the later features ``f``."""
    z = lambda cond: f"CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    # Without any word on either side there is no likeness; a mismatch never counts against a pair.
    none = lambda c, of: f"CASE WHEN f.{c} = 1 AND x.{of} = '' AND y.{of} = '' THEN CAST(0 AS DOUBLE) ELSE f.{c} END"
    both = {"name_addr_interaction": "f.name_char_jaccard * f.addr_char_jaccard"}
    apart = {"co_location_conflict": z("f.num_match = 1 AND f.name_sort_jaccard < 0.45 AND f.name_exact = 0")}
    name, addr = none("name_char_jaccard", "name"), none("addr_char_jaccard", "addr")
    india = {
        "name_tok_jaccard": none("name_tok_jaccard", "name"), "name_char_jaccard": name, "addr_tok_jaccard": none("addr_tok_jaccard", "addr"), "addr_char_jaccard": addr,
        "num_match": f"CASE WHEN {d.at('x.digits', 1)} = {d.at('y.digits', 1)} THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END", "postal_match": "greatest(f.postal_match, CAST(0.5 AS DOUBLE))", "name_addr_interaction": f"({name}) * ({addr})",
    }
    return {"v20": both, "v21": both, "v22": apart, "v23": apart, "india": india}[generation]
