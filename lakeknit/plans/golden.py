"""Records that reach what the documents never do, and what the rules make of them, worked out by hand from the rules' text.

The other checks render one statement for two engines; these expected rows are written out, so
they check the rules themselves: other scripts, notes, trading names, codes, care-of names, phones,
countries with rules of their own, stop words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .linkage import Plan
from .profiles import V20, V30, Profile

ENTITIES = [
    ("S1-01", "Škoda Łódź Ltd", "12 bis Rue de Genève, 75011 Paris", "France"),
    ("S2-01", "Citroe\u0308n S.A.", "12, Gene\u0300ve 75011", "France"),
    ("S1-02", "Παπάς Foods Inc", "Οδός Αθηνάς 5, 10551", "Greece"),
    ("S1-03", "A t/a B trading as C t/a D", "1600 Pennsylvania Avenue, DC 20500-0003", "US"),
    ("S2-03", "Old Co dba New Mart f/k/a Older.com", "Suite 7, 007 Main Street 12345678", "US"),
    ("S1-04", "टाटा Steel Pvt Ltd", "WZ-187C, c/o Ramesh Kumar, Sector 5, New Delhi 110015, 9876543210", "India"),
    ("S3-04", "IBM", "59/101 care of Anil Sharma Near Plaza 6-2-101", "India"),
    ("S2-05", "The Company Ltd", None, "US"),
    ("S3-05", None, "415-555-1212", "US"),
]
STOPWORDS = [("India", "delhi", 9, 0.5), ("US", "pennsylvania", 9, 0.5)]
#: entity_id, name, addr, digits, codes, postal, phone, care_of; lists joined by commas.
RECORDS = [
    ("S1-01", "skoda łodz", "12 geneve 75011 paris", "12,75011", "", "75011", "", ""),
    ("S2-01", "citroen s", "12 geneve 75011", "12,75011", "", "75011", "", ""),
    ("S1-02", "παπας foods", "οδος αθηνας 5 10551", "5,10551", "", "10551", "", ""),
    ("S1-03", "c t d", "1600 20500 0003", "1600,20500,3", "", "20500", "", ""),
    ("S2-03", "old new mart older", "7 007 main 12345678", "7,7", "", "", "", ""),
    ("S1-04", "taataa steel", "187c ramesh kumar 5 new 110015 9876543210", "5,110015", "wz187c", "110015", "9876543210", "ramesh,kumar"),
    ("S3-04", "ibm", "59 101 care anil sharma 6 2 101", "59,101,6,2,101", "59/101,62101", "", "", "anil,sharma"),
    ("S2-05", "the company ltd", "", "", "", "", "", ""),
    ("S3-05", "", "415 555 1212", "415,555,1212", "4155551212", "", "4155551212", ""),
]
#: entity_id, channel, key of some records, by the latest rules and by the first ones.
KEYS = [
    ("S1-04", "acr", "ts"), ("S1-04", "addr_st", "5_187c"), ("S1-04", "addr_st", "5_ramesh"), ("S1-04", "bi_sort", "steel_taataa"), ("S1-04", "code", "wz187c"), ("S1-04", "ex", "taataa steel"),
    ("S1-04", "ph_name", "S340_T300"), ("S1-04", "phone", "9876543210"), ("S1-04", "post_num", "110015_5"), ("S1-04", "tk", "steel"), ("S1-04", "tk", "taataa"),
    ("S3-04", "acr", "ibm"), ("S3-04", "addr_st", "59_care"), ("S3-04", "addr_st", "59_anil"), ("S3-04", "code", "59/101"), ("S3-04", "code", "62101"), ("S3-04", "ex", "ibm"), ("S3-04", "tk", "ibm"),
    ("S1-01", "acr", "sł"), ("S1-01", "addr_st", "12_geneve"), ("S1-01", "addr_st", "12_paris"), ("S1-01", "bi_sort", "skoda_łodz"), ("S1-01", "ex", "skoda łodz"), ("S1-01", "post_num", "75011_12"), ("S1-01", "tk", "skoda"), ("S1-01", "tk", "łodz"),
]
KEYS_V20 = [
    ("S1-04", "addr_co", "ramesh_kumar"), ("S1-04", "addr_num_st", "5_187c"), ("S1-04", "addr_num_st2", "5_ramesh"), ("S1-04", "bi", "taataa_steel"), ("S1-04", "code", "wz187c"), ("S1-04", "comp", "taataasteel"), ("S1-04", "ex", "taataa steel"),
    ("S1-04", "post_num", "110015_5"), ("S1-04", "tk", "steel"), ("S1-04", "tk", "taataa"),
    ("S3-04", "addr_co", "anil_sharma"), ("S3-04", "addr_num_st", "59_care"), ("S3-04", "addr_num_st2", "59_anil"), ("S3-04", "code", "59/101"), ("S3-04", "code", "62101"), ("S3-04", "ex", "ibm"), ("S3-04", "tk", "ibm"),
]


def plan(spark: SparkSession, profile: Profile = V30) -> Plan:
    entities = spark.createDataFrame([(*r, None) for r in ENTITIES], "entity_id string, business_name string, business_address string, country string, truth_key string")
    stops = spark.createDataFrame(STOPWORDS, "country string, word string, n long, share double")
    return Plan(spark, {"entities": entities, "stopwords": stops}, profile)


def records(spark: SparkSession) -> DataFrame:
    lists = [f"array_join({c}, ',') AS {c}" for c in ("digits", "codes", "care_of")]
    return plan(spark).step("records").selectExpr("entity_id", "name", "addr", *lists, "postal", "phone")


def keys(spark: SparkSession, profile: Profile, expected: list[tuple]) -> DataFrame:
    of = sorted({r[0] for r in expected})
    return plan(spark, profile).step("keys").filter("entity_id IN (" + ", ".join(f"'{x}'" for x in of) + ")").select("entity_id", "ch", "val")


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


QUERIES = {
    "link_golden_records": lambda spark, _: records(spark),
    "link_golden_keys": lambda spark, _: keys(spark, V30, KEYS),
    "link_golden_keys_v20": lambda spark, _: keys(spark, V20, KEYS_V20),
}
SQL = {
    "link_golden_records": _values(RECORDS, "entity_id, name, addr, digits, codes, postal, phone, care_of"),
    "link_golden_keys": _values(KEYS, "entity_id, ch, val"),
    "link_golden_keys_v20": _values(KEYS_V20, "entity_id, ch, val"),
}
