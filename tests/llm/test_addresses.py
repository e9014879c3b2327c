from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.llm.addresses import address_forms, address_values, form_keys, same_building

SAME = [
    "61 Cedtal Street / 103889 Peldimouth", "PELDIMOUTH; No. 61, Cedtal St.", "Flat 9, 61 Cedtal Str\n10-3889\nUnited Kingdom",
    "61 Cdetal Street, Peldimouth, UK-103889", "#12, Cedtal Street, no 61, Peldimuoth", "Peldimouth103889, 61 Cedtal St",
]
OTHER = [
    "62 Cedtal Street / 103889 Peldimouth", "61b Cedtal Street, Peldimouth", "61 Cedtal Lane, Peldimouth", "61 Cedtal Street, Vorpipol",
    "61 Mirtal Street, Peldimouth", "Peldimouth", "", "   ", "?!", "x" * 5000, "9" * 3000,
]
PAIRS = [
    ("пер. Гаргате 38 б,г. Керкидорф,Россия", "Gargate pereulok, house 38b, Kerkidorf"), ("rue Zorlin 13a\nCedgeburg", "13-A, r. Zorlin, Cedgeburg, FR"),
    ("Ralverweg 139, Apt. 7, Rosteport, 549 963", "139 Ralverweg Rosteport"), ("Avenida Zelver 231 / Grimask", "Av. Zelver nº 231, 388004 Grimask, ES"),
    ("Lumtalstraße 5, Wenketon", "Wenketon, Lumtalstr. 5"), ("ul. Belver 20, Larpeka", "20 Belver str., Larpeka"),
]


def values(spark, addresses):
    return spark.createDataFrame([(f"r{i:02d}", a) for i, a in enumerate(addresses)], "id string, address string")


def test_same_and_other_buildings(spark):
    got = {(r.id_a, r.id_b) for r in same_building(values(spark, SAME + OTHER)).collect()}
    n = len(SAME)
    # r03 has its error in the street, r04 in the town
    assert got == {(f"r{i:02d}", f"r{j:02d}") for i in range(n) for j in range(i + 1, n)}


def test_writings_share_a_key():
    for a, b in PAIRS:
        ka = {k for s, _, h, t, c in address_forms(a) for k in form_keys(s, h, t, c)}
        kb = {k for s, _, h, t, c in address_forms(b) for k in form_keys(s, h, t, c)}
        assert ka & kb, (a, b, address_forms(a), address_forms(b))
    assert address_forms(None) == [] and address_forms("12345") == []
    assert {f[2] for f in address_forms("Hurdell Road 102 335 125 Vorpipol")} == {"102", "125"}


def test_pairs_table(spark):
    rows = [
        (ent("a", address=[SAME[0], None, ""]), ent("b", schema="Company", address=SAME[1]), "positive"),
        (ent("c", schema="Position", address=SAME[0]), ent(None, address=SAME[0]), "positive"), (ent("d", address=None), None, None),
        (ent("a", address=[OTHER[0]]), ent("e", address=[OTHER[0]]), "positive"),
    ]
    df = pairs(spark, rows).withColumn("town", F.lit(1)).withColumn("address", F.lit(1))
    assert sorted(map(tuple, same_building(address_values(df)).collect())) == [("a", "b"), ("a", "e")]
    assert same_building(address_values(df.limit(0))).count() == 0


def test_errors_in_street_and_town(spark):
    df = values(spark, ["51 Barsson Street, Krapaholm, 568281", "51 Barson Street, Krapaaholm", "51 Barnsen Street, Krapaaholm"])
    assert list(map(tuple, same_building(df).collect())) == [("r00", "r01")]


def test_other_formats(spark):
    written = [
        "1 Broadway, New York", "Broadway 1, New York", "Via Roma 10, Milano", "10 Via Roma, Milano", "Rua Augusta 100, Lisboa", "Rua Augusta 100, Lisboa",
        "10 Main Street, 10115 Berlin", "Main St. 10, Berlin", "12 North Main Street, Springfield 62704", "12 North Main St, Springfield", "1 Baker Street, London SW1A 1AA",
        "1 Baker St, London", "12 South Main Street, Springfield",
    ]
    got = {(r.id_a, r.id_b) for r in same_building(values(spark, written)).collect()}
    assert got == {(f"r{i:02d}", f"r{i + 1:02d}") for i in range(0, 12, 2)}
