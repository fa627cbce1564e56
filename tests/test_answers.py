"""Provider answers: their shapes, what is dropped, and that a followed folder is read once."""

import datetime as dt
import json

from tidemark.sources import answers

BAR = {"open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 10}


def write(folder, name, answer):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(answer if isinstance(answer, str) else json.dumps(answer))


def test_end_of_day_answers(spark, tmp_path):
    day = lambda d: {"date": d, **BAR}
    write(tmp_path / "in", "a.json", {"symbol": " spy ", "historical": [day("2024-01-03"), day("2024-01-02 00:00:00"), day("soon"), {"date": "2024-01-01"}]})
    write(tmp_path / "in", "b.json", [{"symbol": "qqq", **day("2024-01-02")}, {"symbol": "no symbol", **day("2024-01-02")}, {**day("2024-01-05")}])
    write(tmp_path / "in", "c.json", '{"Error Message": "limit reached"}')
    write(tmp_path / "in", "d.json", "<html>502</html>")
    write(tmp_path / "in", "e.json", [])
    got = sorted((r.ticker, r.ts, r.close) for r in answers.eod_bars(answers.answers(spark, str(tmp_path / "in"))).collect())
    close = dt.time(21)
    assert got == [("QQQ", dt.datetime.combine(dt.date(2024, 1, 2), close), 1.5), *[("SPY", dt.datetime.combine(dt.date(2024, 1, d), close), 1.5) for d in (2, 3)]]


def test_quotes_and_macro(spark, tmp_path):
    write(tmp_path / "q", "q.json", [{"symbol": "spy", "price": 470.5, "timestamp": 1704229200}, {"symbol": "X", "price": None, "timestamp": 1}, {"symbol": "Y", "price": 1.0}])
    got = answers.quotes(answers.answers(spark, str(tmp_path / "q"))).selectExpr("ticker", "unix_seconds(ts) AS s", "price").collect()
    assert [tuple(r) for r in got] == [("SPY", 1704229200, 470.5)]
    write(tmp_path / "m", "m.json", {"symbol": "^VIX", "historical": [{"date": "2024-01-03", "close": 14.0}, {"date": "2024-01-02", "close": None}]})
    write(tmp_path / "m", "n.json", [{"symbol": "DXUSD", "date": "2024-01-02", "close": 102.5}, {"symbol": "AAPL", "date": "2024-01-02", "close": 1.0}])
    got = sorted(map(tuple, answers.macro(answers.answers(spark, str(tmp_path / "m")), lag_days=2).collect()))
    assert got == [("dxy", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4), 102.5), ("vix", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5), 14.0)]


def test_a_followed_folder_is_read_once(spark, tmp_path):
    seen = []

    def run():
        stream = answers.eod_bars(answers.followed(spark, str(tmp_path / "in")))
        query = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.ticker for r in b.collect())))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    write(tmp_path / "in", "a.json", [{"symbol": "A", "date": "2024-01-02", **BAR}])
    run()
    write(tmp_path / "in", "b.json", [{"symbol": "B", "date": "2024-01-02", **BAR}])
    run()
    run()
    assert seen == [["A"], ["B"]]
