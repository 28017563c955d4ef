"""Cleaning, risk, market, catalog, search, exposure, sources, sinks,
streaming and model operators on small fixtures, plus the driver contract."""

import datetime as dt
import hashlib
import os
from datetime import date
import zipfile

import pytest
from pyspark.sql import functions as F

from paths import SF_CHECK, SF_SMALL
from lumen.operators import catalog as G
from lumen.operators import clean as D
from lumen.operators import exposure as X
from lumen.operators import market as T
from lumen.operators import model as M
from lumen.operators import risk as H
from lumen.operators import search as N
from lumen.sources import sinks as K
from lumen.sources.csv import pandas_header, read_csv_table
from lumen.sources.tables import standardize_names
from lumen.sources.workbooks import read_workbooks
from lumen.streaming.submissions import append_submissions, read_log

# ----------------------------------------------------------------- cleaning


def test_fill_strategies(employees):
    assert D.remove_duplicates(employees)[1] == 1
    assert D.drop_missing_rows(employees, "Salary").count() == 5
    assert "Country" not in D.drop_column(employees, "Country").columns
    ages = [r.Age for r in D.fill_median(employees, "Age").collect()]
    assert None not in ages and 23.0 in ages
    assert D.fill_mean(employees, "Name").collect() == employees.collect()  # text: no-op
    mode = D.fill_mode(employees, "Age").where("Name = 'Eve'").collect()[0].Age
    assert mode == 22.0
    assert D.fill_constant(employees, "Age", None).collect() == employees.collect()
    assert D.handle_missing(employees, "Age", "no_such_strategy").collect() == employees.collect()
    with pytest.raises(ValueError):
        D.fill_mean(employees, "missing_col")


def test_cast_int_and_float(spark):
    df = spark.createDataFrame([("12",), ("x",), ("1d",), ("1e3",), (" 3 ",), ("",), (None,)], "v string")
    assert [r.v for r in D.cast_int(df, "v").collect()] == [12, None, None, 1000, 3, None, None]
    assert [r.v for r in D.cast_float(df, "v").collect()] == [12.0, None, None, 1000.0, 3.0, None, None]
    bad = spark.createDataFrame([("1.5",)], "v string")
    with pytest.raises(Exception):
        D.cast_int(bad, "v").collect()


def test_cast_datetime_and_str(spark):
    df = spark.createDataFrame([("2024-01-02",), ("02/01/2024",), ("x",)], "v string")
    got = [r.v for r in D.cast_datetime(df, "v").collect()]
    assert got == [dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 1), None]
    n = spark.createDataFrame([(1.5,), (None,)], "v double")
    assert [r.v for r in D.cast_str(n, "v").collect()] == ["1.5", None]


# ----------------------------------------------------------------- risk


def test_risk_tiers_and_kpis(spark):
    scores = [(i, i / 10.0) for i in range(11)]
    df = H.risk_tiers(spark.createDataFrame(scores, "id long, risk_score double"))
    tiers = {r.id: r.risk_tier for r in df.collect()}
    assert tiers[0] == "Low Risk" and tiers[10] == "High Risk"
    # monotone in score
    order = [tiers[i] for i in range(11)]
    assert order == sorted(order, key=H.TIERS.index)
    k = H.risk_kpis(df).collect()[0]
    assert k.total_customers == 11 and k.revenue_at_risk == f"${k.high_risk_count * 450:,}"
    empty = H.risk_kpis(spark.createDataFrame([], "risk_score double, risk_tier string")).collect()[0]
    assert (empty.total_customers, empty.avg_risk, empty.revenue_at_risk) == (0, 0.0, "$0")


def test_risk_tiers_repeated_edges_error(spark):
    df = spark.createDataFrame([(0.5,)] * 5 + [(0.9,)], "risk_score double")
    with pytest.raises(ValueError):
        H.risk_tiers(df)


def test_prompts_routing(spark):
    pred = spark.createDataFrame([(0.9, "High Risk"), (0.1, "Low Risk")], "risk_score double, risk_tier string")
    prompts = spark.createDataFrame([("What is the REVENUE risk?",), ("why do they leave",), ("hello",)],
                                    "prompt string")
    out = [r.insight for r in H.answer_prompts(prompts, pred).collect()]
    assert out[0].startswith("Financial Risk Exposure: <strong>$450</strong>")
    assert out[1] == H.DRIVERS_TEXT and "evaluating <strong>2</strong>" in out[2]


def test_churn_summary_uses_existing_label(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (1,)], "churned int")
    assert H.churn_summary(df).collect()[0].churn_rate_pct == 50.0


# ----------------------------------------------------------------- market


def test_market_edge_cases(spark):
    d = dt.date(2024, 1, 1)
    prices = spark.createDataFrame(
        [("A", d, 10.0, 1), ("B", d, 0.0, 1), ("B", d + dt.timedelta(1), 5.0, 1),
         ("B", d + dt.timedelta(2), 6.0, 1)], "symbol string, day date, close double, volume long")
    ch = {r.symbol: r for r in T.latest_change(prices).collect()}
    assert ch["A"].change_pct is None and ch["B"].change_pct == 20.0 and ch["B"].band == "green"
    vol = {r.symbol: r.volatility for r in T.volatility(prices).collect()}
    assert vol["A"] is None and vol["B"] is None  # one return only (the 0 close gives none)
    assert T.price_series(prices).where("symbol = 'A'").collect()[0].label == "Jan 01"


# ----------------------------------------------------------------- catalog / search


def test_watchlist_and_ratings(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(1, 7, "toggle", 0, t, 1), (1, 7, "toggle", 0, t, 2), (1, 7, "toggle", 0, t, 3),
         (1, 8, "toggle", 0, t, 4), (1, 8, "remove", 0, t, 5),
         (1, 9, "rate", 3, t, 6), (1, 9, "rate", 5, t, 7)],
        "user_id long, item_id long, action string, rating int, ts timestamp_ntz, id long")
    assert [(r.item_id, r.toggles) for r in G.watchlist(ev).collect()] == [(7, 3)]
    r = {x.item_id: x.rating for x in G.ratings(ev).collect()}
    assert r == {7: 0, 8: 0, 9: 5}


def test_search_snippets_wildcards_and_null_tags(spark):
    df = spark.createDataFrame([(1, "Sort 100%", "c", None), (2, "a_b", "c", "x"), (3, "axb", "c", "PY")],
                               "id int, title string, code string, tags string")
    assert [r.id for r in N.search_snippets(df, "%").collect()] == [1, 2, 3]
    assert sorted(r.id for r in N.search_snippets(df, "a_b").collect()) == [2, 3]
    assert [r.id for r in N.search_snippets(df, "py").collect()] == [3]


def test_search_titles_empty_query(spark):
    items = spark.createDataFrame([(1, "Red", 1.0)], "item long, title string, vote_average double")
    pop = spark.createDataFrame([(1, 3.0)], "item long, popularity double")
    assert G.search_titles(items, pop, "   ").count() == 0
    assert G.search_titles(items, pop, " red ").collect()[0].item == 1


# ----------------------------------------------------------------- exposure


def test_secret_exposure(spark):
    corpus = X.hash_corpus(spark.createDataFrame([("hunter2",), ("hunter2",), ("abc",)], "s string"), "s")
    secrets = spark.createDataFrame([("hunter2",), ("nope",)], "secret string")
    got = {r.secret: (r.breached, r["count"]) for r in X.secret_exposure(secrets, corpus).collect()}
    assert got == {"hunter2": (True, 2), "nope": (False, 0)}
    h = hashlib.sha1(b"abc").hexdigest().upper()
    assert corpus.where(F.col("prefix") == h[:5]).collect()[0].suffix == h[5:]
    with pytest.raises(Exception):
        X.secret_exposure(spark.createDataFrame([("",)], "secret string"), corpus).collect()


def test_email_exposure(spark):
    emails = spark.createDataFrame([("test@example.com",), ("x@y.org",)], "email string")
    breaches = spark.createDataFrame([("test@example.com", "Canva"), ("test@example.com", "Adobe")],
                                     "email string, breach string")
    got = {r.email: (r.breached, r.breaches) for r in X.email_exposure(emails, breaches).collect()}
    assert got == {"test@example.com": (True, "Adobe, Canva"), "x@y.org": (False, "")}


# ----------------------------------------------------------------- sources and sinks


def test_standardize_names(spark):
    df = spark.createDataFrame([(1, 2)], "` Monthly Charges` int, `Total-Charges` int")
    assert standardize_names(df).columns == ["monthly_charges", "total_charges"]
    with pytest.raises(ValueError):
        standardize_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_csv_reader(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "data.csv")
    with open(p, "w") as f:
        f.write("id,,score,score,flag,when\n1,a,NA,1.5,True,2024-01-02\n2,N/A,7,2,False,x\n3,b,,3,True,\n")
    df = read_csv_table(spark, p)
    assert df.columns == ["id", "Unnamed: 1", "score", "score.1", "flag", "when"]
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "Unnamed: 1": "string", "score": "double", "score.1": "double",
                     "flag": "boolean", "when": "string"}
    header_only = os.path.join(tmpdir_path, "empty.csv")
    with open(header_only, "w") as f:
        f.write("email,subject,message\n")
    assert read_csv_table(spark, header_only).count() == 0
    with pytest.raises(ValueError):
        read_csv_table(spark, os.path.join(tmpdir_path, "x.parquet"))
    assert pandas_header(["a", "a", "", "a.1"]) == ["a", "a.1", "Unnamed: 2", "a.1.1"]


def _write_xlsx(path, rows):
    def cell(r, c, v):
        ref = chr(65 + c) + str(r + 1)
        if isinstance(v, date):
            return f'<c r="{ref}" s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>"
                   for r, row in enumerate(rows))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                                      f'<sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="ws"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmpdir_path):
    _write_xlsx(os.path.join(tmpdir_path, "a.xlsx"), [["name", "age"], ["Ann", 22], ["Bob", 24]])
    _write_xlsx(os.path.join(tmpdir_path, "b.xlsx"), [["name", "age"], ["Cid", 45]])
    df = read_workbooks(spark, tmpdir_path)
    assert sorted((r.name, r.age) for r in df.collect()) == [("Ann", 22), ("Bob", 24), ("Cid", 45)]


def test_workbooks_are_stacked_by_name(spark, tmpdir_path):
    _write_xlsx(os.path.join(tmpdir_path, "a.xlsx"), [["name", "age", "since"], ["Ann", 22, date(2024, 1, 2)]])
    _write_xlsx(os.path.join(tmpdir_path, "b.xlsx"), [["age", "city", "name"], [45, "Rome", "Cid"]])
    df = read_workbooks(spark, tmpdir_path)
    assert df.columns == ["name", "age", "since", "city"]
    assert sorted(tuple(r) for r in df.collect()) == [("Ann", 22, "2024-01-02 00:00:00", None), ("Cid", 45, None, "Rome")]


def test_snippet_defaults(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "t", "c")], "id int, title string, code string")
    path = os.path.join(tmpdir_path, "snip")
    K.insert_snippets(df, path)
    row = spark.read.parquet(path).collect()[0]
    assert (row.tags, row.is_favorite) == ("", False)
    bad = spark.createDataFrame([(2, None, "c")], "id int, title string, code string")
    with pytest.raises(Exception):
        K.insert_snippets(bad, path)


def test_submission_stream(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    rows = [("a@b.c", "Hi", 'He said "yes",\nthen left'), ("d@e.f", "x", "plain")]
    spark.createDataFrame(rows, "email string, subject string, message string").write.json(src)
    q = append_submissions(spark, src, os.path.join(tmpdir_path, "log"), os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in read_log(spark, os.path.join(tmpdir_path, "log")).collect())
    assert got == sorted(rows)


# ----------------------------------------------------------------- models


def test_models_properties(spark, tmpdir_path):
    from lumen.plans import inputs as I
    docs = I.labeled_docs(spark, SF_CHECK).where("quality IS NOT NULL")
    trained, scored = M.fit_model(docs, "quality", features=["lang", "source", "n_chars", "toxic"], key="doc_id")
    imp = M.feature_importances(spark, trained).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-9
    assert 0.0 <= trained.metrics["metric_value"] <= 1.0
    scores = M.risk_scores(scored).select("risk_score").collect()
    assert all(0.0 <= r.risk_score <= 1.0 for r in scores)
    path = os.path.join(tmpdir_path, "model")
    M.save_model(trained, path)
    again = M.load_model(path)
    a = trained.model.transform(M.prepare_features(docs, trained)).select("prediction").collect()
    b = again.model.transform(M.prepare_features(docs, again)).select("prediction").collect()
    assert a == b
    assert (again.features, again.task, again.target, again.medians) == (
        trained.features, trained.task, trained.target, trained.medians)
    assert M.score_batch(again, docs, keep=["doc_id"]).count() == docs.count()
    shares = {(r.label, r.part): r.rows for r in M.split_shares(spark.read.parquet(f"{SF_CHECK}/labels.parquet"),
                                                                "quality", "doc_id").collect()}
    for lab in {k[0] for k in shares}:
        n = shares.get((lab, "train"), 0) + shares.get((lab, "test"), 0)
        assert shares[(lab, "train")] == int(0.8 * (n - 1)) + 1


def test_churn_auc_above_chance(spark):
    from lumen.plans import inputs as I
    trained, tiers = M.churn_pipeline(I.churn_customers(spark, SF_CHECK), "customer_id")
    assert trained.metrics.get("auc", 0) > 0.5
    assert tiers.count() == spark.read.parquet(f"{SF_CHECK}/customer.parquet").count()


# ----------------------------------------------------------------- driver contract


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 70


@pytest.mark.parametrize("name", ["chart_histogram", "risk_tiers", "watchlist", "secret_exposure",
                                  "fill_median", "chart_categories"])
def test_oracle_small(spark, name):
    import duckdb
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("customer orders lineitem events part documents labels benchmark conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(sdf.columns)

    def norm(rows, names):
        idx = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in rows),
                      key=repr)
    assert norm([tuple(r) for r in sdf.collect()], sdf.columns) == norm(cur.fetchall(), cols)
