import random
from itertools import permutations

from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.llm.names import best_assignment, birth_dates, match_strength, name_key, named_records, same_names

FULL = [
    ("Wilhelmina Rösnadouri", "ROSNADOURI, Mina", True), ("Ileta Sornasshvili", "Sornazshvili Ileta", True), ("Harar Gölkalers", "Нarаr Gоlkalers", True),
    ("Харандер Росдагард", "Harander Rösdagard", True), ("Edward K. Kradabers", "Mr. Edward Kradabers", True), ("Fady Tripisetti", "Fadmira Tripisetti", True),
    ("The Jorporigo Maritime Minerals PLC", 'P.L.C. "Jororigo Minerals Maritime"', False), ("Zimgelatec Dev. & Co.", "Zimgelatec Development Company", False),
    ("Rosdagodyn Svcs", "Rosdagodyn Services, Ltd", False), ("Pookisant Mfg", "Pookisant Manufacturing Public Limited Company", False),
]
WEAK = [("I. Sornasshvili", "Ileta Sornasshvili", True), ("Belfazigo Agricultural Chemicals", "Belfazigo Agricultural", False)]
NONE = [
    ("Ileta Sornasshvili", "Orar Sornasshvili", True), ("Mina", "Mina X.", True), ("Kelpigeon Finance", "Kelpigeon Shipping", False),
    ("Ltd.", "Ltd.", False), ("", "", True), ("A. B.", "A. B.", True), ("x" * 4000, "y", True),
]


def test_strengths():
    for want, cases in ((2, FULL), (1, WEAK), (0, NONE)):
        for a, b, person in cases:
            ka, kb = name_key(a, person), name_key(b, person)
            assert match_strength(ka, kb, person) == want == match_strength(kb, ka, person), (a, b, ka, kb)


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        n, more = rng.randrange(1, 6), rng.randrange(3)
        v = [[rng.randrange(9) for _ in range(n + more)] for _ in range(n)]
        got = best_assignment(v)
        assert len(set(got)) == n
        best = max(sum(v[i][j] for i, j in enumerate(p)) for p in permutations(range(len(v[0])), n))
        assert sum(v[i][j] for i, j in enumerate(got)) == best


def test_records(spark):
    rows = [
        (ent("a", "Ileta Sornasshvili", birthDate="1964-12-12"), ent("b", "I. Sornasshvili", birthDate="1964-12-12"), "positive"),
        (ent("c", "Sornazshvili Ileta", birthDate="1971"), ent("d", "SORNASSHVILI ILETA", birthDate=["1964"]), None),
        (ent("e", "Ileta Sornasshvili"), ent("f", None, name=["I. Sornasshvili", "", None]), None),
        (ent("g", "Rosdagodyn Services Ltd", schema="Company"), ent("h", "Rosdagodyn Svcs", schema="LegalEntity", birthDate="x"), "negative"),
        (ent("i", "Ileta Sornasshvili", schema="Position"), ent("", "Ileta Sornasshvili"), None), (None, None, None),
    ]
    df = pairs(spark, rows).withColumn("name", F.lit(1)).withColumn("person", F.lit(1))
    got = sorted(map(tuple, same_names(named_records(df), birth_dates(df)).collect()))
    # the initials of f may mean someone of 1964 or of 1971
    assert got == [("a", "b"), ("a", "d"), ("a", "e"), ("b", "d"), ("c", "e"), ("d", "e"), ("g", "h")]
    assert same_names(named_records(df.limit(0)), birth_dates(df.limit(0))).count() == 0


def named(spark, names):
    """Records of persons with the ids given, without birth dates."""
    return pairs(spark, [(ent(i, n), None, None) for i, n in names.items()])


def test_short_names_meet_their_long_form(spark):
    two = [("Robert", "Bob"), ("Wilhelmina", "Mina"), ("Elizabeth", "Beth"), ("Ivan", "Vanya"), ("William", "Bill"), ("Mohammed", "Mo")]
    names = {f"{i}{side}": f"{n} Hartm{'aeiouy'[i] * 3}nn" for i, two_of in enumerate(two) for side, n in zip("ab", two_of, strict=True)}
    df = named(spark, names | {"7a": "Mohammed Li", "7b": "Mo Li", "8a": "Bob Li"})
    want = [(f"{i}a", f"{i}b") for i in (*range(len(two)), 7)]
    assert sorted(map(tuple, same_names(named_records(df), birth_dates(df)).collect())) == want


def test_initials_without_any_known_date(spark):
    df = named(spark, {"a": "E. Hesnoneira", "b": "Erosh Hesnoneira"})
    assert list(map(tuple, same_names(named_records(df), birth_dates(df)).collect())) == [("a", "b")]


def test_frequent_tokens_stay_keys(spark):
    crowd = {f"x{i:02d}": f"{g} Kareta Rosfagume" for i, g in enumerate("Bod Dulm Fenk Gant Hask Jolt Lund Murb Nast Pilk Rund Sovt".split())}
    names = {"a": "Ile Kareta Rosfagume", "b": "Ilenne Kareta Rosfagume", "c": "Vorl Rosfagume", "d": "V. Rosfagume", "e": "Jon Rosfagume", "f": "John Rosfagume"}
    got = set(map(tuple, same_names(named_records(named(spark, crowd | names)), birth_dates(named(spark, crowd | names))).collect()))
    assert {("a", "b"), ("c", "d"), ("e", "f")} <= got
