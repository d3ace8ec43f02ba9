"""Hosts of URLs, small hosts, and columns of any name."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigrid.llm import linededup
from trigrid.llm.common import Workspace


def test_url_hosts(spark):
    urls = {"https://User:pw@Www.Example.com:8080/a?b=c": "www.example.com", "http://[::1]:80/x": "[::1]", "no url": None, "ftp://h": "h", "": None, None: None, "http:///x": None}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", linededup.url_host(F.col("url")).alias("h"))
    assert {r.url: r.h for r in df.collect()} == urls


def test_small_hosts_and_clashing_names(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [("http://a/1", "menu\none"), ("http://a/2", "menu\ntwo"), ("http://a/3", "three\n\n"), ("http://b/1", "menu"), ("http://c/1", None), ("http://d/1", long), ("http://d/2", long + "\nend")]
    pages = spark.createDataFrame(rows, "url string, text string").withColumns({"host": F.lit("x"), "page": F.lit(1), "__host": F.lit(2), "kept": F.lit(3), "drop": F.lit(4)})
    got = linededup.drop_boilerplate(pages, Workspace(spark), host=linededup.url_host(F.col("url")), dropped="went")
    assert got.columns == [*pages.columns, "went"]
    by = {r.url: (r.text, r.went) for r in got.collect()}
    assert by == {"http://a/1": ("one", 1), "http://a/2": ("two", 1), "http://a/3": ("three\n\n", 0), "http://b/1": ("menu", 0), "http://c/1": (None, 0), "http://d/1": ("", 20_000), "http://d/2": ("end", 20_000)}
    # At a limit of two thirds the menu on two of three pages stays: it doesn't exceed it.
    kept = linededup.drop_boilerplate(pages, Workspace(spark), host=linededup.url_host(F.col("url")), max_ratio=2 / 3)
    assert {r.url: r.text for r in kept.collect()}["http://a/1"] == "menu\none"
