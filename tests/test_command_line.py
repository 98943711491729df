"""The command line over small tables: what it prints, and an index written in place of another."""

from tidewell.__main__ import main


def test_commands(spark, tmp_path, capsys):
    d, i = str(tmp_path / "docs"), str(tmp_path / "index")
    spark.createDataFrame([(1, "some red words"), (2, "more red things here")], "doc_id long, text string").write.parquet(d)
    main(["index", d, i, "--tokens", "3"])
    main(["search", i, "red + some", '"red things"', "[ open"])
    out = capsys.readouterr().out
    assert "2 documents indexed" in out and "1 results for 'red + some'" in out and "1 results for '\"red things\"'" in out and "0 results for '[ open'" in out
    page = lambda k, *links: (k, f"https://s.com/{k}", "<title>T</title>word" + "".join(f' <a href="{x}">t</a>' for x in links))
    spark.createDataFrame([page(1, "/2"), page(2), page(3)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "seeds").write_text("https://s.com/1\n")
    main(["crawl", str(tmp_path / "seeds"), str(tmp_path / "pages"), i, "--rounds", "2"])
    main(["search", i, "word"])
    out = capsys.readouterr().out
    assert "2 pages met" in out and "2 results for 'word'" in out
    main(["index", "--pages", str(tmp_path / "pages"), i])
    main(["search", i, "t#"])
    assert "3 results for 't#'" in capsys.readouterr().out
