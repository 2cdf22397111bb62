"""Normalisation of business names and addresses, as SQL expressions."""

from __future__ import annotations

from .dialect import Spark

# Words that say nothing about a name, words of street types, spellings that a wrong
# character set leaves behind, and the Latin letters of Devanagari signs.
SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "co", "company", "group", "holdings", "enterprise", "enterprises",
    "pllc", "llp", "lp", "associates", "association", "services", "solutions", "partners", "opc", "sarl", "sas", "sasu", "eurl", "sci", "snc", "gie", "societe", "sa",
    "and", "or", "of", "in", "at", "the", "a", "an",
)
STREET_WORDS = (
    "road", "street", "avenue", "lane", "drive", "floor", "shop", "near", "beside", "behind", "block", "unit", "suite", "apt", "box", "post", "boulevard", "place", "circle", "square", "nagar",
    "colony", "marg", "bhavan", "complex", "plaza", "building", "center", "house", "tower", "phase", "sector", "point", "cross",
    "rue", "chemin", "allee", "impasse", "quai", "cours", "passage", "route", "bis", "ter", "quater", "bd", "av", "che", "imp", "all", "r",
)
MISREAD = {"PrAcsident": "President", "A%cole": "Ecole", "SantAc": "Sante", 'RenaudiA"re': "Renaudiere", "ClAcment": "Clement", 'SuA"de': "Suede", "ThAcnard": "Thenard", "RAcunis": "Reunis"}
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh",
    "ष": "sh", "स": "s", "ह": "h", "ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "े": "e", "ै": "ai",
    "ो": "o", "ौ": "au", "ं": "n", "्": "",
}
#: What isn't part of a word, in any script.
MARKS = r"[^\p{L}\p{N}_\s]+"


def tokens(d: Spark, s: str) -> str:
    """The words of a text between blanks, none empty."""
    return d.keep(d.split(s, r"\s+"), "t", "t <> ''")


def transliterated(d: Spark, s: str) -> str:
    """Indic letters in Latin: every block of 128 from Bengali to Malayalam stands where Devanagari does; unknown signs vanish."""
    blocks = "".join(chr(c) for c in range(0x0980, 0x0D80))
    home = "".join(chr(0x0900 + (c - 0x0900) % 0x80) for c in range(0x0980, 0x0D80))
    out = f"translate({s}, {d.text(blocks)}, {d.text(home)})"
    for sign, latin in DEVANAGARI.items():
        if len(latin) != 1:
            out = f"replace({out}, {d.text(sign)}, {d.text(latin)})"
    single = {k: v for k, v in DEVANAGARI.items() if len(v) == 1}
    rest = "".join(chr(c) for c in range(0x0900, 0x0980) if chr(c) not in DEVANAGARI)
    out = f"translate({out}, {d.text(''.join(single) + rest)}, {d.text(''.join(single.values()))})"
    return f"CASE WHEN {d.like(s, '[' + chr(0x900) + '-' + chr(0xD7F) + ']')} THEN {out} ELSE {s} END"


def universal(d: Spark, s: str) -> str:
    """Misread spellings repaired, Indic letters in Latin, accents gone, lower case; null counts as empty."""
    out = f"coalesce({s}, '')"
    for wrong, right in MISREAD.items():
        out = f"replace({out}, {d.text(wrong)}, {d.text(right)})"
    out = d.sub(d.sub(out, "A[c%]([a-z])", "e\\1"), 'A"([a-z])', "e\\1")
    return d.unmarked(transliterated(d, f"replace({out}, {d.text(chr(0xFFFD))}, {d.text('')})"))


def without_notes(d: Spark, lowered: str) -> str:
    """A name without d/b/a, formerly, f/k/a, a/k/a (slashes or not) and domain endings."""
    out = d.sub(lowered, r"\b(d/?b/?a|formerly|f/?k/?a|a/?k/?a)\b", " ")
    return d.sub(out, r"\.(com|in|org|net|fr|co|us|gov|edu)\b", "")


def own_words(d: Spark, words: str, noise: str) -> str:
    """The words that aren't noise; all of them if none is left."""
    own = d.keep(words, "t", f"NOT {d.has(noise, 't')}")
    return f"CASE WHEN {d.size(own)} > 0 THEN {d.join(own, ' ')} ELSE {d.join(words, ' ')} END"


def clean_name(d: Spark, lowered: str, extra: tuple[str, ...] = ()) -> str:
    """A universal name's own words: the trading name, without notes, domains, marks, legal forms and ``extra`` words; all words if none is left."""
    trading = f"CASE WHEN {lowered} LIKE '% trading as %' THEN regexp_replace({lowered}, '^.* trading as ', '') WHEN {lowered} LIKE '% t/a %' THEN regexp_replace({lowered}, '^.* t/a ', '') ELSE {lowered} END"
    return own_words(d, tokens(d, d.sub(without_notes(d, trading), MARKS, " ")), d.strings(SUFFIXES + extra))


def clean_address(d: Spark, lowered: str, stops: str | None = None) -> str:
    """A universal address's numbers and its words of three letters or more that are neither street types nor among ``stops``."""
    words = tokens(d, d.sub(lowered, MARKS, " "))
    told = f" AND NOT {d.has(stops, 't')}" if stops else ""
    return d.join(d.keep(words, "t", f"({d.like('t', r'^\p{N}+$')}) OR (length(t) >= 3 AND NOT {d.has(d.strings(STREET_WORDS), 't')}{told})"), " ")


def address_digits(d: Spark, s: str) -> str:
    """All numbers without leading zeros, of seven digits at most, in order, repeats included."""
    found = d.each(d.all(s, r"\b[0-9]+\b"), "t", "ltrim(t, '0')" if d.name == "duckdb" else "ltrim('0', t)")
    return d.keep(found, "t", "length(t) BETWEEN 1 AND 7")


def postal_code(d: Spark, s: str, country: str) -> str:
    """The last number that looks like a postal code of the country; empty without one."""
    pick = lambda p: f"coalesce({d.at(d.all(s, p), -1)}, '')"
    return f"CASE WHEN {country} = 'India' THEN {pick(r'\b[1-9][0-9]{5}\b')} WHEN {country} IN ('US', 'France') THEN {pick(r'\b[0-9]{5}\b')} ELSE {pick(r'\b[0-9]{4,6}\b')} END"


def complex_codes(d: Spark, s: str) -> str:
    """House codes of letters and numbers, fractions and triples, hyphens removed."""
    return d.each(d.all(f"lower({s})", r"\b[a-z]{1,3}-[0-9]{2,4}[a-z]?\b|\b[0-9]+/[0-9]+\b|\b[0-9]+-[0-9]+-[0-9]+\b"), "t", "replace(t, '-', '')")


def phone(d: Spark, s: str) -> str:
    """The first phone number's last ten digits; empty without one."""
    found = f"coalesce({d.at(d.all(s, r'\b[6-9][0-9]{9}\b|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}'), 1)}, '')"
    return f"right({d.sub(found, '[^0-9]', '')}, 10)"


def acronym(d: Spark, words: str) -> str:
    """The first letters of two to six words."""
    able = d.keep(words, "t", d.like("t", r"^[\p{L}\p{N}]"))
    return f"CASE WHEN {d.size(able)} BETWEEN 2 AND 6 THEN {d.join(d.each(able, 't', 'left(t, 1)'), '')} ELSE '' END"


def distinctiveness(d: Spark, name: str, words: str) -> str:
    """How telling a name is, from 0 to 1, by its words and length."""
    n, k = f"length({name})", d.size(words)
    add = lambda cond, x: f"CASE WHEN {cond} THEN CAST({x} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    parts = [add(f"{k} >= 2", 0.25), add(f"{k} >= 4", 0.20), add(f"{n} >= 12", 0.20), add(f"{n} >= 22", 0.15)]
    return f"CASE WHEN {name} = '' THEN CAST(0 AS DOUBLE) ELSE round(least(CAST(1 AS DOUBLE), CAST(0.2 AS DOUBLE) + {' + '.join(parts)}), 6) END"


def soundex(d: Spark, token: str) -> str:
    """Four characters of sound: every letter without a code, H and W too, ends a run of equal codes; empty unless a letter begins."""
    codes = f"translate({d.sub(token, '[^bcdfgjklmnpqrstvxz]', '0')}, 'bfpvcgjkqsxzdtlmnr', '111122222222334556')"
    for k in "123456":
        codes = d.sub(codes, f"{k}+", k)
    rest = f"replace(substring({codes}, 2), '0', '')"
    return f"CASE WHEN {d.like(f'coalesce({token}, {d.text("")})', '^[a-z]')} THEN rpad(left(concat(upper(left({token}, 1)), {rest}), 4), 4, '0') ELSE '' END"


def ngrams(d: Spark, s: str, n: int) -> str:
    """The character n-grams of a text with blanks as underscores; a shorter text is its own."""
    under = f"replace({s}, ' ', '_')"
    many = d.each(d.numbers("1", f"greatest(1, length({s}) - {n - 1})"), "i", f"substring({under}, CAST(i AS INT), {n})")
    return f"CASE WHEN {s} = '' THEN {d.empty} ELSE {d.sorted(d.distinct(many))} END"
