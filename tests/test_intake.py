"""Logs, maps and control texts of odd layouts; late rows; sampling in turn against refits; two-rate mixtures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidewell.operators import posterior, sequential
from tidewell.sources import logs, model_text
from tidewell.streaming import readings as streams


def files(spark, **texts):
    return spark.createDataFrame([(k, t if t is None or isinstance(t, bytes) else bytearray(t.encode())) for k, t in texts.items()], "file string, content binary")


def sites(spark):
    return spark.createDataFrame([("A", "J1"), ("B", "J2"), ("007", "J7"), ("C", "J3"), ("C", "J4")], "tap string, junction string")


def told(df):
    return {(r["file"], r["line_no"]): (r["site"], str(r["date"]) if r["date"] else None, r["minute"], r["value"], r["reason"]) for r in df.collect()}


def test_layouts_encodings_units_and_states(spark):
    found = told(
        logs.read_logs(
            files(
                spark,
                plain='Tap,Sample Date,Time,Free Chlorine (ug/L)\nA,2024-03-05,9:15 PM,"1200"\n\n7,2024-03-06,0830,<50\n"B",2024-03-07,,ND\nC,2024-03-08,,1\nX,2024-03-08,,1\n,2024-03-08,,1\n',
                titled="Town of X\nChlorine results\nSite;Date;Result;Units\nA;31/01/2024 14:05;0,45;mg/L\nB;01/02/2024;55;mg/L\nB;30/02/2024;0,5;mg/L\n",
                hinted=b"\xef\xbb\xbfsep=|\nstation|collected|value\nA|3 Mar 2024|0.5\nB|March 4, 2024|>2.2\nB|2024-03-05T10:30:00Z|?\n",
                unsure="tap,date,chlorine\nA,03/04/2024,0.5\nB,05/04/2024,0.6\n",
                both="tap,date,chlorine\nA,13/04/2024,0.5\nB,04/13/2024,0.6\n",
                unnamed="tap,date,x1,x2\nA,2024-01-01,north,0.7\nB,2024-01-02,south,0.8\n",
                lacking="colour,weight\nred,3\n",
                empty="", none=None, words="just words\nand more\n",
            ),
            "file", "content", sites(spark), "tap", "junction",
        )
    )
    assert found[("plain", 2)] == ("J1", "2024-03-05", 21 * 60 + 15, pytest.approx(1.2), None)
    assert found[("plain", 4)][0] == "J7" and found[("plain", 4)][2:] == (8 * 60 + 30, pytest.approx(0.05), "below detection")
    assert [found[("plain", n)][4] for n in (5, 6, 7, 8)] == ["below detection", "key names several sites", "unknown key", "no key"]
    assert found[("titled", 4)] == ("J1", "2024-01-31", 14 * 60 + 5, 0.45, None)
    assert [found[("titled", n)][4] for n in (5, 6)] == ["over 10 mg/L", "unreadable date"]
    assert [found[("hinted", n)][1:] for n in (3, 4, 5)] == [("2024-03-03", None, 0.5, None), ("2024-03-04", None, 2.2, "above range"), ("2024-03-05", 630, None, "unreadable reading")]
    assert {found[("unsure", n)][4] for n in (2, 3)} == {"day and month in either order"} and {found[("both", n)][4] for n in (2, 3)} == {"dates in both orders"}
    assert [found[("unnamed", n)][3:] for n in (2, 3)] == [(0.7, None), (0.8, None)]
    assert found[("lacking", 2)][4] == "no tap column, no date column"
    assert {found[(f, 0)][4] for f in ("empty", "none", "words")} == {"no rows"}
    assert len(found) == 6 + 3 + 3 + 2 + 2 + 2 + 1 + 3


def test_a_known_order_settles_dates(spark):
    one = files(spark, unsure="tap,date,chlorine\nA,03/04/2024,0.5\n")
    assert [told(logs.read_logs(one, "file", "content", sites(spark), "tap", "junction", order=o))[("unsure", 2)][1] for o in ("DMY", "MDY")] == ["2024-04-03", "2024-03-04"]


def test_tap_maps_and_inlet_files(spark):
    got = {(r["line_no"]): (r["tap"], r["junction"], r["reason"]) for r in logs.read_tap_map(files(spark, m="Tap ID;Junction\nA;J1\nB;J2\nA;J1\nC;J3\nC;J4\n;J5\nD;\n"), "file", "content").collect()}
    assert got == {2: ("A", "J1", None), 3: ("B", "J2", None), 4: ("A", "J1", "repeated"), 5: ("C", "J3", "tap has several values"), 6: ("C", "J4", "tap has several values"), 7: (None, "J5", "no tap"), 8: ("D", None, "no junction")}
    inlet = "inlet_node_id,residual_ug/L\nR1,800\nR2,ND\nR3,20000\nR1,800\nR4,1\nR4,2\n"
    got = {(r["line_no"]): (r["inlet"], r["residual"], r["reason"]) for r in logs.read_inlet_residuals(files(spark, i=inlet), "file", "content").collect()}
    assert got[2] == ("R1", pytest.approx(0.8), None) and [got[n][2] for n in range(3, 8)] == ["no measured residual", "over 10 mg/L", "repeated", "inlet has several values", "inlet has several values"]


def scanned(spark, text):
    data = model_text.section_lines(model_text.lines_of(spark.createDataFrame([(1, text)], "file int, text string"), "file", "text"), "file")
    return {(r["kind"], r["id"]) for r in model_text.control_scan(data, "file").collect()}, [tuple(r)[1:] for r in model_text.control_counts(data, "file").collect()]


def test_a_premise_only_reads(spark):
    text = "[CONTROLS]\nlink 5 OPEN IF node 7 BELOW 3\nPUMP 8 is no control's link\n[RULES]\nRULE a\nIF PUMP 10 STATUS IS OPEN\nAND node N1 DEMAND ABOVE 3\nOR JUNCTION N2 head ABOVE 3\nTHEN PIPE 20 STATUS IS OPEN\nAND PUMP 21 SETTING IS 1\nELSE VALVE 22 STATUS IS OPEN\nPRIORITY 2\nAND LINK 30\nRULE b\nLINK 31 STATUS\nIF NODE\nTHEN link\n[TIMES]\nLINK 40 OPEN\n"
    assert scanned(spark, text) == ({("link", "5"), ("node", "7"), ("node", "N2"), ("link", "20"), ("link", "21"), ("link", "22")}, [(2, 2)])
    assert scanned(spark, "[PIPES]\nP1 a b\n") == (set(), []) and scanned(spark, "") == (set(), [])


def test_late_rows_are_kept_and_add_up(spark, tmp_path):
    """Four files out of order: late is what lies a day before the latest time of earlier files."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [[(1, day(1)), (2, day(3))], [(3, day(2)), (4, day(1, 23)), (5, day(9))], [(6, day(8)), (7, day(7, 23)), (8, None)], [(9, day(2)), (10, day(10))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    stream = streams.replay(spark, f"{tmp_path}/in/*", spark.createDataFrame([], "id long, ts timestamp").schema)
    on_time, late = streams.split_late(stream, "ts", "1 day", f"{tmp_path}/out")
    assert {r["id"] for r in late.collect()} == {4, 7, 9} and {r["id"] for r in on_time.collect()} == {1, 2, 3, 5, 6, 8, 10}
    again = streams.split_late(streams.replay(spark, f"{tmp_path}/in/*", stream.schema), "ts", "1 day", f"{tmp_path}/out")
    assert again[0].count() + again[1].count() == 10


def test_state_step_by_step_is_a_refit(spark):
    """n = 3 to 15: the posterior that the loop carries is that of all samples so far at once, and its choice follows from it."""
    grid = [(h, j, m, -0.1 * m * (j % 5 + 1) - 0.02 * h * (m % 3)) for h in range(0, 24, 4) for j in range(20) for m in range(6)]
    g = spark.createDataFrame(grid, "hour int, junction int, member int, z double")
    truth = [(r, j, h, -0.25 * (j % 5 + 1) - 0.01 * h - 0.05 * r) for r in range(2) for j in range(20) for h in range(0, 24, 4)]
    t = spark.createDataFrame(truth, "run int, junction int, hour int, y double")
    found = sequential.sample_in_turn(g, t, t.where("hour = 8 and junction < 3"), 12, 0.3, -0.9)
    rows = found.collect()
    z = {(h, j, m): v for h, j, m, v in grid}
    for run in range(2):
        own = sorted((r["n"], r["hour"], r["junction"], r["y"]) for r in rows if r["run"] == run)
        assert [r[0] for r in own] == list(range(1, 16)) and len({r[2] for r in own}) == 15
        for n in range(3, 15):
            ll = [sum(-0.5 * ((y - z[h, j, m]) / 0.3) ** 2 for _, h, j, y in own[:n]) for m in range(6)]
            w = [math.exp(x - max(ll)) for x in ll]
            mean = lambda f: sum(a * f(m) for m, a in enumerate(w)) / sum(w)  # noqa: B023, E731
            score = {}
            for h in range(0, 24, 4):
                for j in set(range(20)) - {r[2] for r in own[:n]}:
                    mu = mean(lambda m: z[h, j, m])  # noqa: B023
                    score[h, j] = round(1.96 * math.sqrt(max(mean(lambda m: z[h, j, m] ** 2) - mu * mu, 1e-12)) - abs(mu + 0.9), 9)  # noqa: B023
            assert own[n][1:3] == min(score, key=lambda k: (-score[k], *k))
    w = {(r["run"], r["member"]): r["w"] for r in sequential.refit(g, found, 0.3).collect()}
    assert sum(v for (run, _), v in w.items() if run == 0) == pytest.approx(1)


def test_two_rates_mix_in_concentration(spark):
    g = spark.createDataFrame([(k, p, -k * p) for k in (0.1, 0.5, 900.0) for p in (1, 2)], "kb double, place int, z double")
    got = {(r["fast"], r["slow"], r["share"], r["place"]): r["z"] for r in posterior.two_rate_grid(g, "kb", ["place"], "z", (0.25, 0.5)).collect()}
    assert len(got) == 6 + 3 * 2 * 2 and got[0.5, 0.1, 0.25, 2] == pytest.approx(math.log(0.25 * math.exp(-1) + 0.75 * math.exp(-0.2)))
    assert got[900.0, 0.1, 0.5, 2] == pytest.approx(math.log(0.5) - 0.2) and got[0.1, None, 1.0, 1] == -0.1
    with pytest.raises(ValueError, match="same members"):
        posterior.two_rate_grid(g.where("kb < 1 or place = 1"), "kb", ["place"], "z", (0.5,))
    both = spark.range(1).select(posterior.log_sum_exp(F.lit(1000.0), F.lit(1000.0)).alias("big"), posterior.log_sum_exp(F.lit(-1000.0), F.lit(-1001.0)).alias("small")).first()
    assert both["big"] == pytest.approx(1000 + math.log(2)) and both["small"] == pytest.approx(-1000 + math.log1p(math.exp(-1)))


def test_priors_and_several_deviations(spark):
    grid = spark.createDataFrame([(h, j, [-0.1 * m * (j + 1) for m in range(4)]) for h in range(2) for j in range(3)], "hour int, junction int, z array<double>")
    samples = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.5), (1, 0, 0.01)], "hour int, junction int, y double")
    sds = [0.2, 0.5]
    for student in (None, 3.0):
        got = {r["member"]: r["loglik"] for r in posterior.log_likelihood_of_sds(grid, samples, sds, student).collect()}
        alone = [{r["member"]: r["loglik"] for r in posterior.log_likelihood(grid, samples, sd, student).collect()} for sd in sds]
        for m in range(4):
            u = [(math.log(max(y, 0.02)) + 0.1 * m * (j + 1)) / sds[0] for _, j, y in ((0, 1, 0.8), (1, 2, 0.5), (1, 0, 0.01))]
            term = sum(-0.5 * x * x if student is None else -0.5 * (student + 1) * math.log1p(x * x / student) for x in u) - 3 * math.log(sds[0])
            assert alone[0][m] == pytest.approx(term) and got[m] == pytest.approx(math.log((math.exp(alone[0][m]) + math.exp(alone[1][m])) / 2))
    loglik = spark.createDataFrame([(0, -1.0), (1, -2.0), (2, -3.0)], "member int, loglik double")
    prior = spark.createDataFrame([(0, math.log(0.1)), (1, math.log(0.9))], "member int, log_prior double")
    w = {r["member"]: r["w"] for r in posterior.weights(loglik, prior).collect()}
    assert set(w) == {0, 1} and w[0] == pytest.approx(0.1 * math.e / (0.1 * math.e + 0.9))
