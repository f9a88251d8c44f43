"""Extraction, normalisation and validation on small pinned rows."""

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as T
from lodestream.operators import combination, evidence, normalize, rules, validate
from lodestream.spec import ASSAYS, MISSING
from lodestream.streaming import incremental

NONE = {"section": None, "table_id": None, "figure_id": None, "row_index": None, "extraction_method": "t", "confidence": 0.9}


def document(spark, pages=(), tables=(), name="a.pdf"):
    src = lambda p, t=None: NONE | {"source_file": name, "page": p, "table_id": t}
    row = (name, len(pages), {}, [{"text": t, "source": src(i)} for i, t in enumerate(pages, 1)], [{"table_id": f"p1_t{i}", "rows": r, "source": src(1, f"p1_t{i}")} for i, r in enumerate(tables, 1)])
    return spark.createDataFrame([row], evidence.PARSED)


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def raw(spark, pages=(), tables=()):
    return rules.extract(evidence.chunks(document(spark, pages, tables), ASSAYS), ASSAYS).orderBy(*rules.ORDER)


def test_prose_record(spark):
    r = raw(spark, ["Compound 5a: MIC < 4 ug/mL against S. aureus"]).collect()
    assert [(x.compound_id, x.target_type, x.target_relation, x.target_value, x.target_units, x.bacteria) for x in r] == [("5a", "MIC", "<", "4", "ug/mL", "S. aureus")]


@pytest.mark.parametrize(
    ("text", "val", "unit"),
    [("Table 2 (MIC, mM) compound 1 12", None, "mM"), ("MIC=12.5µmolmL−1 here", "12.5", "µmolmL−1"), ("no unit in the text", None, MISSING), ("values 5 and 12 mg/L then", "12", "mg/L"), ("in mM: the value 7 is", "7", "mM")],
)
def test_unit(spark, text, val, unit):
    assert value(spark, text, lambda c: rules.unit_of(c, None if val is None else F.lit(val))) == unit


def test_sentence_final_number_is_not_supported(spark):
    ok = lambda t, v: value(spark, t, lambda c: validate.supported(F.lit(v), c))
    assert not ok("MIC = 4.", "4") and ok("MIC = 4 mM", "4") and ok("4-8 range", "4-8") and not ok("only 4", "999") and not ok("4", "4-")


CODED = "Antibacterial activity (MIC, µg/mL)\nCompounds S.aureus B.subtilis E.coli P.aeruginosa C.albicans A.niger\nBK-1 12 20 >50 30 40 50\nBK-2 8 9 16 30 40 50\nBK-3 6.25 9 - 30 40 50\nBK-4 4 9 25 30 40 50"


def test_coded_table(spark):
    r = raw(spark, [CODED]).collect()
    got = [(x.compound_id, x.target_relation, x.target_value, x.bacteria) for x in r]
    assert got == [("BK-1", "=", "12", "S. aureus"), ("BK-1", ">", "50", "E. coli"), ("BK-2", "=", "8", "S. aureus"), ("BK-2", "=", "16", "E. coli"), ("BK-3", "=", "6.25", "S. aureus"), ("BK-4", "=", "4", "S. aureus"), ("BK-4", "=", "25", "E. coli")]
    assert all(x.target_units == "µg/mL" and x.confidence == 0.85 for x in r)
    assert r[0].evidence_text.split("\n") == [CODED.split("\n")[0], CODED.split("\n")[1], "BK-1 12 20 >50 30 40 50"]


def test_short_table(spark):
    r = raw(spark, ["MIC values (µg/mL)\nCompd. no\nBc Sa Pa Ec Ab Ca\n5a 4 8 16 32 64 1\n5b 2 - 16 >64 1 1\nCiprofloxacin 1 1 1 1"]).collect()
    assert [(x.compound_id, x.target_relation, x.target_value, x.bacteria) for x in r] == [("5a", "=", "8", "S. aureus"), ("5a", "=", "32", "E. coli"), ("5b", ">", "64", "E. coli")]


def test_pair_table(spark):
    r = raw(spark, ["Entry MIC (µM) c of strains and MRSA MIC (µM) d\n12 1.2 ± 0.1 42.33 21.16 >100 55\nNovobiocin 1 2 3 4 5 6"]).collect()
    assert [(x.compound_id, x.target_value, x.bacteria, x.target_units) for x in r] == [("12", "42.33", "MTCC 3160", "µM"), ("12", "21.16", "MRSA", "µM")]


LABELLED = ["Antibacterial MSSA MRSA", "Entry Code EC PA SF", "1 1a 64 1 1 64 128 9 9", "2 1b >64 1 1 32 - 9 9"]


@pytest.mark.parametrize("turned", [False, True])
def test_labelled_table(spark, turned):
    lines = [x[::-1] for x in LABELLED] if turned else LABELLED
    r = raw(spark, ["\n".join([*lines, "MRSA" if not turned else "ASRM"])]).collect()
    assert [(x.compound_id, x.target_relation, x.target_value) for x in r] == [("1a", "=", "64"), ("1a", "=", "64"), ("1a", "=", "128"), ("1b", ">", "64"), ("1b", "=", "32")]
    assert {x.target_units for x in r} == {"mg/mL"}


def test_vertical_table(spark):
    cells = ["1", "2", "3", "4", "5", "6", "7", "128", "64", "10", "11", "64"]
    r = raw(spark, ["\n".join(["Antibacterial", "MSSA", "MRSA", "Code", "Entry", *cells, "1a", "1"])]).collect()
    assert [x.target_value for x in r] == ["64", "64", "128"] and {x.confidence for x in r} == {0.8}


def tabled(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "r long, text string")  # a column named as the output is
    return [(x.text, [(y.compound_id, y.target_relation, y.target_value, y.bacteria) for y in x.r]) for x in rules.table_records(d).collect()]


def test_header_in_mid_page_and_two_tables(spark):
    head = "Compounds S.aureus B.subtilis E.coli"
    page = f"Results of the assays\nBK-9 99 99 99\nMIC (µg/mL)\n{head}\nBK-1 12 20 30\nsome prose\nE.coli B.subtilis S.aureus Compounds\nBK-2 1 2 3 4\n{head}\n{head}\nBK-3 <7 8 -"
    (_, got), = tabled(spark, page)
    # before any header a row belongs to no table; a cell is read under the header nearest above it
    assert got == [("BK-1", "=", "12", "S. aureus"), ("BK-1", "=", "30", "E. coli"), ("BK-2", "=", "2", "S. aureus"), ("BK-3", "<", "7", "S. aureus")]
    short = "MIC (µg/mL)\nCompd. no\nBc Sa Pa Ec\n1a 1 2 3 4\nnote\nEc Pa Sa Bc\n1b 5 6 7 8"
    (_, got), = tabled(spark, short)
    assert got == [("1a", "=", "2", "S. aureus"), ("1a", "=", "4", "E. coli"), ("1b", "=", "5", "E. coli"), ("1b", "=", "7", "S. aureus")]


def test_first_kind_with_records_wins(spark):
    pair = "Entry MIC (µM) c of strains and MRSA MIC (µM) d\n12 1.2 ± 0.1 42.33 21.16 >100 55\nND, indicates\n13 1 2 3 4 5"
    (_, got), = tabled(spark, "AB-1 is named here\n" + pair)  # looks like a coded table and gives no row
    assert [x[0] for x in got] == ["12", "12"]
    (_, got), = tabled(spark, CODED + "\n" + pair)
    assert {x[0][:3] for x in got} == {"BK-"}


def test_tables_of_odd_texts(spark):
    assert tabled(spark, None, "", "MIC", "no table", "Compd. no MIC (µg/mL)") == []
    assert len(tabled(spark, CODED, CODED)) == 2  # repeated rows give their records each
    rows = "\n".join(f"BK-{i % 999 + 1} {i} 20 30 40 50 60" for i in range(30000))
    (_, got), = tabled(spark, "\n".join([*CODED.split("\n")[:2], rows]))
    assert len(got) == 60000 and got[-1][2] == "30"
    assert rules.table_records(spark.createDataFrame([], "text string, x int")).columns == ["text", "x", "r"]


def test_page_with_a_table_gives_no_prose(spark):
    both = raw(spark, [CODED, "Compound 9a: MIC = 3 ug/mL for E. coli"], [[["x", "MIC = 7 mg/L E. coli"]]]).collect()
    assert {x.page for x in both if x.stage == 0} == {1} and {x.page for x in both if x.stage == 1} == {2}


def test_windows_follow_python(spark):
    text = "a MIC " * 3 + "é" * 20 + " E. coli end"
    import re

    want = [text[max(0, m.start() - 5) : m.end() + 5].strip() for m in re.finditer(r"MIC|E\. coli", text)]
    assert value(spark, text, lambda c: T.windows(c, r"MIC|E\. coli", 5)) == want


def test_selected_evidence_and_budget(spark):
    pages = ["MIC of compound 5a was 4 µg/mL against S. aureus. " + "x" * 5, "E. coli MIC 8 mg/L", "nothing here"]
    e = evidence.select(document(spark, pages, [[["Table", "MIC"], ["id", "S. aureus"], ["5a", "MIC 4"]]]), ASSAYS)
    rows = e.orderBy("part", "ord1", "ord2").collect()
    assert rows[0].evidence_id == "table-1" and rows[2].source_text.startswith("Table | MIC | id | S. aureus\n5a")
    assert all(r.confidence == min(0.95, 0.45 + r.score / 10) for r in rows)
    few = evidence.within_budget(e, ASSAYS, 5)
    assert few.count() <= 5 and {r.page for r in few.collect()} == {1, 2}
    assert evidence.near_collapse(e, ASSAYS).count() <= e.count()


def test_slices(spark):
    d = spark.createDataFrame([("a", i) for i in range(10)], "g string, i int")
    for s in ("2:5", ":3", "-3:", "1:-1", "20:", "-20:2"):
        a, _, b = s.partition(":")
        want = list(range(10))[slice(int(a) if a else None, int(b) if b else None)]
        assert [r.i for r in evidence.sliced(d, ["g"], ["i"], s).orderBy("i").collect()] == want
    with pytest.raises(ValueError, match="START:STOP"):
        evidence.sliced(d, ["g"], ["i"], "3")


def test_dois(spark):
    d = evidence.dois(document(spark, ["see 10.1039/C5RA23282A. and (10.1021/acs.1), again 10.1039/c5ra23282a"]))
    assert {r.doi for r in d.collect()} == {"10.1039/c5ra23282a", "10.1021/acs.1"}


@pytest.mark.parametrize(
    ("kind", "name", "want"),
    [("MIC", "S. aureus ATCC29213", "S. aureus ATCC 29213"), ("MIC", "Escherichia coli", "E. coli"), ("MIC", "mrsa", "MRSA N315"), ("pMIC", "E.coli", "EC"), ("pMIC", "Staph. aureus", "SA"), ("MIC", "B. subtilis", "B. subtilis"), ("MIC", MISSING, MISSING)],
)
def test_labels(spark, kind, name, want):
    assert value(spark, name, lambda c: normalize.label(F.lit(kind), c)) == want


@pytest.mark.parametrize(("v", "want"), [("4.0", "4"), ("1e3", "1000"), ("0.50-2.0", "0.5-2"), ("1,5", "1.5"), ("x", "x"), (MISSING, MISSING), ("-0", "-0"), ("4-", "4-"), ("100", "100")])
def test_values(spark, v, want):
    assert value(spark, v, normalize.value) == want


def test_units_and_records(spark):
    assert [value(spark, u, normalize.unit) for u in ("ug / mL", "μg mL −1", "mg/L", "UG/ML", "mmol/l")] == ["µg/mL", "µg/mL", "µg/mL", "UG/ML", "mmol/L"]
    r = normalize.record(raw(spark, ["Compound 5a: pMIC >= 4 mg/L against E.  coli"])).first()
    assert (r.target_type, r.target_relation, r.target_units) == ("pMIC", ">", "µg/mL")


def test_split_names_every_missing_field(spark):
    r = normalize.record(raw(spark, ["MIC 4 is the value", "Compound 5a: MIC = 8 mg/L S. aureus"]))
    ok, bad = validate.split(r, list(rules.ORDER))
    assert [x.target_value for x in ok.collect()] == ["8"]
    assert bad.first().message.startswith("record 0: missing required evidence-backed values: ")
    assert ok.count() + bad.count() == r.count()


def test_invented_value_is_rejected(spark):
    r = normalize.record(raw(spark, ["Compound 5a: MIC = 8 mg/L S. aureus"])).withColumn("target_value", F.lit("999"))
    assert validate.checked(r).first().error == "target_value is not supported by evidence text: 999"


def test_repair(spark):
    cols = "compound_id string, smiles string, target_type string, target_relation string, target_value string, target_units string, bacteria string, evidence_id string"
    items = spark.createDataFrame([(None,) * 8, ("5a", "CCO", "pmic", "<=", "1,5", "mM", "E. coli", "e1"), ("5b", "C1", "odd", "~", "7", "mM", "x", "e1")], cols)
    ev = spark.createDataFrame([("e1", "value 1.5 for CCO")], "evidence_id string, source_text string")
    a, b, c = sorted(validate.repaired(items, ev).collect(), key=lambda r: r.compound_id if r.compound_id != MISSING else "")
    assert a.target_value == MISSING and "compound_id_missing" in a.warnings
    assert (b.target_type, b.target_relation, b.target_value, b.smiles) == ("pMIC", "<", "1.5", "CCO") and b.warnings == ["relation_truncated:<=", "target_value_decimal_comma_normalized"]
    assert (c.target_type, c.target_relation, c.smiles) == (MISSING, "=", MISSING)
    assert {"invalid_target_type:odd", "invalid_target_relation:~", "target_value_not_found_in_evidence:7", "target_relation_defaulted_to_equals"} <= set(c.warnings)


@pytest.mark.parametrize(("s", "want"), [("C(C", "invalid"), ("*C(=O)R1", "generic_scaffold"), ("C C", "invalid"), ("CCO", "not_configured"), (MISSING, "not_applicable"), ("C[N", "invalid")])
def test_structures(spark, s, want):
    assert value(spark, s, validate.structure_status) == want


def test_forbidden_inputs():
    validate.refuse_forbidden("data/parsed/a.json")
    with pytest.raises(ValueError, match="ground truth"):
        validate.refuse_forbidden("data\\x\\Ground_Truth.csv")


def test_combination_rows(spark):
    text = "Silver nanoparticles of 10-20 nm showed a MIC of 8 ug/ml against E. coli."
    r = combination.extract(document(spark, [text])).collect()
    assert len(r) == 2 and r[0].NP == "Ag"  # the abbreviated genus ends a piece, and the carry joins it again
    assert r[0].bacteria == "Escherichia coli" and r[0].method == "MIC"
    assert r[0][combination.NP_VALUE] == "8" and (r[0]["NP_size_avg_nm"], r[0]["NP_size_min_nm"], r[0]["NP_size_max_nm"]) == ("10", "10", "20")
    assert combination.extract(document(spark, ["Silver nanoparticles are used against E. coli with zone tests."])).count() == 0
    table = [["NP", "Bacteria", "Drug"], ["AgNPs zone", "E. coli", "gentamycin and ampicillin"]]
    t = combination.numbered(combination.extract(document(spark, [], [table]))).orderBy("sn").collect()
    # the header row holds a signal ("ug" in "drug") too, and takes its fields from the whole table
    assert [(x.drug, x.sn, x.row_id) for x in t] == [("Ampicillin", "1", "1"), ("Gentamicin", "2", "1"), ("Ampicillin", "3", "2"), ("Gentamicin", "4", "2")]
    assert len(combination.review(combination.numbered(combination.extract(document(spark, [text])))).columns) == 17


def test_header_fields(spark):
    d = spark.createDataFrame([(["id", "FICI", "MIC (µg/ml)", "more"], ["1", "0.5 x", "16.0"])], "h array<string>, c array<string>")
    s = d.select(combination.header_fields(F.col("h"), F.col("c")).alias("s")).first().s
    got = dict(zip(combination.FIELDS, s, strict=True))
    assert (got["FIC"], got[combination.BOTH_VALUE], got["method"]) == ("0.5", "16.0", "MIC")


def test_six_digits(spark):
    assert [value(spark, v, T.six_digits) for v in ("12.50", "1234567", "0,5", "x", None)] == ["12.5", "1.23457e+06", "0.5", "x", None]


def test_stream_of_documents(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    document(spark, ["Compound 5a: MIC < 4 ug/mL against S. aureus"]).write.json(src)
    stream = spark.readStream.schema(evidence.PARSED).json(src)
    incremental.run(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).first().target_value == "4"


def test_queries_and_their_sql_are_registered_alike():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_dictionary_of_any_size(spark):
    import time

    from lodestream.functions import dictionary

    names = [f"name{i}" for i in range(10_000)] + ["straße", "amikacin", "Δx"]
    texts = {"Amikacin, name7; name77 name9999!": ["name7", "name77", "name9999", "amikacin"], "xname7 name7x name_7": [], "STRASSE Straße straße.": ["straße"], "δX and (AMIKACIN)": ["amikacin", "δx"], "": [], "name3 name3 name2": ["name2", "name3"]}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.perf_counter()
    got = d.select("t", dictionary.hits("t", names).alias("h"))
    assert time.perf_counter() - began < 5
    assert {r.t: r.h for r in got.collect()} == texts
    assert spark.createDataFrame([(None,)], "t string").select(dictionary.hits("t", names).alias("h")).first().h is None
    with pytest.raises(ValueError, match="single words"):
        dictionary.hits("t", ["two words"])


def test_snippets_of_odd_blanks(spark):
    from lodestream.operators import combination

    cases = {"A zone.  Then  more; MIC 4 .\n\n; end": ["A zone.", "A zone. Then more;", "Then more; MIC 4 .", "MIC 4 . ;"], None: [], "  ": [], "zone " * 100 + ". b": None}
    for text, want in cases.items():
        got = spark.createDataFrame([(text,)], "t string").select(combination.snippets(F.col("t")).alias("s")).first().s
        assert got == want or want is None and len(got) == 2 and got[1].startswith("one zone") and len(got[1]) <= 353 and got[1].endswith("zone . b"), got
