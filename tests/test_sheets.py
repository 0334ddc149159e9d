from metaloom.operators import sheets as S

HEADERS = {"tissue": "characteristics[organism part]", "age": "characteristics[age]", "modification": "comment[modification parameters]", "sex": "characteristics[sex]"}


def sheet(spark, columns, rows):
    data = [("p", r, c, columns[c][0], columns[c][1], v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(data, "pxd string, row_idx int, col_idx int, header string, field string, cell string")


def laid_out(df):
    rows = {}
    heads = {}
    for r in df.collect():
        rows.setdefault(r.row_idx, {})[r.col_idx] = r.cell
        heads[r.col_idx] = r.header
    assert sorted(heads) == list(range(len(heads)))
    return [heads[c] for c in sorted(heads)], [[rows[r][c] for c in sorted(heads)] for r in sorted(rows)]


def test_corrections_in_order_empty_duplicates(spark):
    cols = [("m", "modification"), ("m", "modification"), ("m", "modification"), ("t", "tissue")]
    cells = sheet(spark, cols, [["NT=Oxidation;TA=M", "NT=Ox;TA=M", "NT=Acetyl", "liver"], ["NT=A", "NT=B", "NT=C", "x"]])
    changes = [(0, 1, 5, "NT=oxidation;TA=M"), (0, 2, 6, None), (0, 3, 7, "Liver tissue"), (1, 0, 1, "NT=X"), (1, 1, 2, "NT=X"), (1, 2, 0, "NT=B"), (1, 3, 9, None)]
    df = spark.createDataFrame([("p", *c) for c in changes], "pxd string, row_idx int, col_idx int, turn int, new string")
    got = {(r.row_idx, r.col_idx): (r.cell, r.action) for r in S.corrected(cells, df).collect()}
    na = "not available"
    assert got == {
        (0, 0): ("NT=Oxidation;TA=M", None), (0, 1): (na, "removed_duplicate"), (0, 2): (na, "removed"), (0, 3): ("Liver tissue", "corrected"),
        # C is to become B while B is still there; then A becomes X, and B, which is to become X too, goes.
        (1, 2): (na, "removed_duplicate"), (1, 0): ("NT=X", "corrected"), (1, 1): (na, "removed_duplicate"), (1, 3): (na, "removed"),
    }


def test_recovered_values_fill_or_insert_columns(spark):
    cols = [("source name", "other"), ("characteristics[age]", "age"), ("m", "modification"), ("m", "modification"), ("factor value[x]", "factor")]
    cells = sheet(spark, cols, [["s1", "not available", "NT=A", "", "f"], ["s2", "", "NT=B", "not available", "g"]])
    rec = [(0, "sex", "male"), (1, "modification", "NT=C"), (2, "age", "5Y"), (3, "modification", "NT=D"), (4, "tissue", "liver"), (5, "nonsense", "x"), (6, "sex", "female"), (7, "tissue", "n/a"), (8, "other", "no")]
    df = spark.createDataFrame([("p", *r) for r in rec], "pxd string, seq int, field string, value string")
    heads, rows = laid_out(S.filled(cells, df, HEADERS))
    assert heads == ["source name", "characteristics[age]", "m", "m", "m", "characteristics[sex]", "characteristics[organism part]", "factor value[x]"]
    assert rows == [["s1", "5Y", "NT=A", "NT=C", "NT=D", "male", "liver", "f"], ["s2", "5Y", "NT=B", "NT=C", "NT=D", "male", "liver", "g"]]


def test_a_table_without_factors_or_modifications(spark):
    cells = sheet(spark, [("source name", "other")], [["a"], ["b"]])
    df = spark.createDataFrame([("p", 0, "modification", "NT=C"), ("p", 1, "age", "9"), ("q", 0, "age", "1")], "pxd string, seq int, field string, value string")
    assert laid_out(S.filled(cells, df, HEADERS)) == (["source name", HEADERS["modification"], HEADERS["age"]], [["a", "NT=C", "9"], ["b", "NT=C", "9"]])
    assert laid_out(S.filled(cells, df.limit(0), HEADERS)) == (["source name"], [["a"], ["b"]])
