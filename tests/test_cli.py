import time

from docloom import cli
from docloom.plans import pipeline
from docloom.sources.store import Store


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.txt").write_text("Budget rules are strict. Costs are reviewed.")
    (tmp_path / "in" / "b.md").write_text("ignored")
    base = ["--store", f"file://{tmp_path}/s", "--dense-size", "32"]
    assert cli.main([*base, "create"], spark) == 0 and cli.main([*base, "health"], spark) == 0
    cli.main([*base, "ingest", str(tmp_path / "in")], spark)
    capsys.readouterr()
    cli.main([*base, "query", "budget", "rules"], spark)
    assert "a.txt" in capsys.readouterr().out
    cli.main([*base, "parse", str(tmp_path / "in")], spark)
    cli.main([*base, "chunk", str(tmp_path / "in")], spark)
    assert capsys.readouterr().out.count("a.txt") >= 2


def test_stream(spark, tmp_path):
    from docloom.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    store = Store(spark, f"file://{tmp_path}/s", pipeline.POINTS, 1024)
    for number in range(2):
        (tmp_path / "in" / f"{number}.txt").write_text(f"Text number {number} arrives.")
        query = ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), chat_id="c")
        assert query.awaitTermination(120)
        assert store.points.count() == number + 1
        time.sleep(0.1)
