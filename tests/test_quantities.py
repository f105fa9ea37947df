import pytest

from lychnos.operators.quantities import normalised_quantities, read_quantity, unit_matches

FX = [("EUR", 1.0), ("USD", 0.92), ("GBP", 1.17), ("SEK", 0.088), ("BGN", 0.511)]


@pytest.fixture(scope="module")
def fx(spark):
    return spark.createDataFrame(FX, "currency_code string, eur_per_unit double")


def amounts(spark, fx, values, note="", field="total_budget"):
    rows = [(i, v, note) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"record_id bigint, {field} string, additional_details string")
    got = {r.record_id: r.amount_norm for r in normalised_quantities(df, fx).collect()}
    return [got.get(i) for i in range(len(values))]


def test_amounts(spark, fx):
    cases = {
        "12.000": 12000, "€12,500": 12500, "17.250,00 €": 17250, "2,020,000.00 EUR": 2020000, "13 500 €": 13500, "6 750 EUR": 6750, "4.5 χιλιάδες ευρώ": 4500,
        "0,75k EUR": 750, "€11,75k": 11750, "1425000 cents": 14250, "2.88 MEUR": 2880000, "EUR 3,19 m": 3190000, "€0,83bn": 830000000, "0.66 δισ. €": 660000000,
        "15.000 € (κύκλος 5)": 15000, "up to €10,750": 10750, "τουλάχιστον 500 €": 500, "US$ 15.000": 13800, "£8.000": 9360, "24.091.000 SEK": 2120008, "1000 λέβα": 511,
        "TBD": None, "": None, " ": None, None: None, "50%": None, "0.5 €": 1, "0.49 €": 0, "100 XYZ": None,
    }
    assert amounts(spark, fx, list(cases)) == list(cases.values())


def test_notes_are_for_bare_amounts(spark, fx):
    assert amounts(spark, fx, ["870", "870 €", "5.400"], "Foo 3 bar. Amounts are in thousand EUR.") == [870000, 870, 5400000]
    assert amounts(spark, fx, ["8,1"], "Ο συνολικός προϋπολογισμός αναφέρεται σε εκατομμύρια ευρώ.") == [8100000]
    assert amounts(spark, fx, ["8,1"], "The budget is quoted in millions of euro.", "minimum_funding_amount") == [8]
    assert amounts(spark, fx, ["1000"], "Ποσά σε USD, όχι σε ευρώ.") == [920]
    assert amounts(spark, fx, ["1000"], "Round 3 makes €9 million available.") == [1000]


def test_rates(spark, fx):
    cases = {"8,25 %": 825, "4%": 400, "610 bps": 610, "0,0450": 450, "9,99": 999, "28.5‰": 285, "5,85% (fixed for 6 years)": 585, "325 μονάδες βάσης": 325, "από 7.5 % ετησίως": 750, "100 €": None, "0": 0}
    assert amounts(spark, fx, list(cases), field="interest_rate") == list(cases.values())


def test_longest_alias_wins():
    assert [m[2] for m in unit_matches("US$ 15 χιλιάδες ευρώ".casefold())] == ["us$", "χιλιάδες".casefold(), "ευρώ"]
    assert unit_matches("european komma") == []


def test_odd_numbers():
    assert read_quantity("1" * 40, False, None) is None
    assert read_quantity("x" * 100_000 + " 5 €", False, None) == ("5.0000000000", "EUR")


def test_long_numbers_are_read_whole(spark, fx):
    cases = {"123.456.789.012.345 €": 123456789012345, "0,00000049 million EUR": 0, "0,0000005 million EUR": 1, "1,23456789 million EUR": 1234568, "999999999999999999": 999999999999999999, "9999999999999999999 EUR": None}
    assert amounts(spark, fx, list(cases)) == list(cases.values())


def test_units_must_be_near_and_known(spark, fx):
    cases = {
        "KWD 5000": None, "CZK 5000": None, "¥ 5000": None, "5.000 Ft": None, "5000 Kč": None, "3 m² at 20.000 €": 20000, "12000 participants, 5 EUR each": 5, "2024: 30.000 €": 30000, "50% of 20.000 EUR": 20000,
        "20 to 50 thousand EUR": 20000, "1-2 million €": 1000000, "5000": 5000, "up to 5000": 5000, "5000 in total": 5000, "40 Tausend Euro": 40000, "2 milhões EUR": 2000000, "50 m²": None, "5000 EUR for 10 years": 5000,
        "5000 were paid out by all of the offices in EUR": 5000,
    }
    assert amounts(spark, fx, list(cases)) == list(cases.values())


def test_notes_in_other_fields_and_languages(spark, fx):
    for note, want in {"Alle Beträge in Tausend Euro.": 7000, "Montants en milliers EUR.": 7000, "Valores em milhões EUR.": 7000000, "Amounts are in thousand EUR.": 7000}.items():
        df = spark.createDataFrame([(1, "7", note)], "record_id bigint, total_budget string, description string")
        assert normalised_quantities(df, fx).first()["amount_norm"] == want, note


def test_the_latest_delivery_counts(spark, fx):
    df = spark.createDataFrame([(1, "5 €", "2024-01-02"), (1, "9 €", "2024-01-01"), (2, "3 €", None)], "record_id bigint, total_budget string, ingested_at string")
    assert {r.record_id: r.amount_norm for r in normalised_quantities(df, fx).collect()} == {1: 5, 2: 3}


def test_repeats_and_empty(spark, fx):
    df = spark.createDataFrame([(1, "5 €"), (1, "5 €")], "record_id bigint, total_budget string")
    assert normalised_quantities(df, fx).count() == 1
    assert normalised_quantities(df.limit(0), fx).count() == 0
    assert normalised_quantities(df.selectExpr("record_id", "total_budget", "1 AS unit", "2 AS power", "3 AS rid"), fx).count() == 1


def test_notes_are_found_in_any_case(spark):
    from lychnos.operators.quantities import ALL_PARTS, ALL_TOPIC, BUDGET_PARTS, BUDGET_TOPIC, note_columns

    notes = ["FIGURES ARE IN THOUSAND EUR.", "Prices are in million EUR.", "PRICES IN EURO.", "ΧΡΗΜΑΤΙΚΈΣ ΤΙΜΈΣ ΣΕ ΧΙΛΙΆΔΕΣ ΕΥΡΏ.", "Τα ποσά σε ευρώ.", "SuMs in million EUR."]
    df = spark.createDataFrame([(n,) for n in [*notes, "BuDgEt in thousand EUR."]], "n string").coalesce(1)
    assert [r[0] for r in df.select(note_columns(["n"], ("a", ALL_TOPIC, ALL_PARTS))["a"]).collect()] == [*notes, ""]
    assert df.select(note_columns(["n"], ("b", BUDGET_TOPIC, BUDGET_PARTS))["b"].alias("b")).where("b <> ''").count() == 1
