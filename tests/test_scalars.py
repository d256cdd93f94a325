"""Scalar functions on the cases that define them."""

import unicodedata

from pyspark.sql import functions as F

from spendgrid.functions import dates as D
from spendgrid.functions import payloads as P
from spendgrid.functions import text as X


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fold_table_agrees_with_decomposition():
    assert len(X.FOLDED_FROM) == len(X.FOLDED_TO)
    assert all(unicodedata.normalize("NFD", a)[0] == b for a, b in zip(X.FOLDED_FROM, X.FOLDED_TO, strict=True))


def test_fold(spark):
    assert col(spark, ["Școala", "Şcoala", "reparaţii", "Grădiniță", "é", None], X.fold_text) == ["scoala", "scoala", "reparatii", "gradinita", "e", None]


def test_normalized_names(spark):
    names = ["S.C. INGRID S.R.L.", "Gradinita PP nr. 4 Lugoj", "Colegiul C.N. Sava", "X SRL-D", "SA SRL Y"]
    assert col(spark, names, X.normalized_name) == ["ingrid", "gradinita pp nr 4 lugoj", "colegiul cn sava", "x d", "y"]
    assert col(spark, names, X.legal_form) == ["srl", None, None, "srl", "sa"]
    assert col(spark, ["gradinita nr 4 lugoj", "nr x", "fnr 5"], X.first_ordinal) == ["4", None, None]


def test_entity_strings(spark):
    raw = ["RO21255449 S.C. INGRID S.R.L.", "29074847 Gradinita PP nr. 4 Lugoj", "RO 14056826 - Societatea X", "4291638 - COMUNA CRISTOLȚ", "Primăria Comunei Vama", "29074847Școala"]
    assert col(spark, raw, X.entity_code) == ["RO21255449", "29074847", "RO14056826", "4291638", None, "29074847"]
    assert col(spark, raw, X.entity_name) == ["S.C. INGRID S.R.L.", "Gradinita PP nr. 4 Lugoj", "Societatea X", "COMUNA CRISTOLȚ", "Primăria Comunei Vama", "Școala"]


def test_fiscal_codes(spark):
    codes = ["21255449", "29074847", "16020748", "21255448", "29074840", "", "1", "12345678901", "ABC", None]
    assert col(spark, codes, X.fiscal_code_valid) == [True, True, True] + [False] * 7
    raw = ["RO21255449", "R361684", "R 16868757", " ro 21255449 ", "0021255449", "RO", None]
    assert col(spark, raw, X.fiscal_code) == ["21255449", "361684", "16868757", "21255449", "21255449", "", ""]
    assert col(spark, ["DE811569869", "1920616123457"], lambda c: X.fiscal_code_valid(X.fiscal_code(c))) == [False, False]


def test_classification_and_units(spark):
    assert col(spark, ["15800000-6 - Diverse (Rev.2)", "not a cpv", " 45453000-7x", "45453000-7"], X.cpv_code) == ["15800000-6", None, None, "45453000-7"]
    assert col(spark, ["Bucată", "BUCATA", "  bucata "], X.unit_key) == ["bucata"] * 3


def test_displays(spark):
    assert col(spark, [21350585413.0, 351294628.0, 1234.0, None, float("nan")], X.format_ron, "double") == ["21,4 mld. lei", "351,3 mil. lei", "1.234 lei", "—", "—"]
    assert col(spark, ["RO123 X", "X", "123456", "", None], X.display_name) == ["X", "X", "123456", X.NO_NAME, X.NO_NAME]
    assert col(spark, ["da:123", "da:x", "da"], X.external_number) == [123, None, None]
    assert col(spark, ["mail a.b@c.ro now", "S.C. ALL@GIS S.R.L."], X.scrub_emails) == ["mail [email redactat] now", "S.C. ALL@GIS S.R.L."]


def test_trigrams(spark):
    assert sorted(col(spark, ["cat"], X.trigrams)[0]) == ["  c", " ca", "at ", "cat"]
    df = spark.createDataFrame([("word", "two words"), ("", "")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(X.trigram_similarity(F.col("a"), F.col("b"))).collect()] == [0.3636, 0.0]


def test_local_days(spark):
    df = spark.sql("select timestamp'2026-07-11 23:30:00' a, timestamp'2026-12-01 22:30:00' b, date'2026-07-12' t")
    r = df.select(D.local_day(F.col("a")).cast("string"), D.local_day(F.col("b")).cast("string"), D.closed_window(F.col("t"), 30).alias("w"), F.size(D.days_of(F.col("t"), F.col("t"))).alias("n")).first()
    assert (r[0], r[1], str(r.w.start), str(r.w.end), r.n) == ("2026-07-12", "2026-12-02", "2026-06-12", "2026-07-11", 1)


def test_redaction_and_hashes(spark):
    doc = {"a": {"assignedUserEmail": "x", "n": 1.0}, "contact": 1, "t": ["write to me@host.ro", "ALL@GIS"], "contactPerson": 2, "org": "kept"}
    once = P.redacted(doc)
    assert once == {"a": {"n": 1.0}, "t": ["write to [email redactat]", "ALL@GIS"], "org": "kept"} and P.redacted(once) == once
    rows = col(spark, ['{"b":1,"a":[2,1]}', '{"a":[2,1],"b":1.0}', '{"a":[1,2],"b":1}', "no json", None], lambda c: P.redact_and_hash(c)["content_hash"])
    assert rows[0] == rows[1] != rows[2] and len(rows[0]) == 64 and rows[3] is rows[4] is None
