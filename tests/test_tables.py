"""Sources, sinks, order-aware operators, catalogue and terms, lookups."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from accessio.operators import catalogue, relational, report, terms
from accessio.schema import MASTER, RAW_ROWS, SEARCH_TERMS, TERM_RESULTS, conform
from accessio.sources import lookup, tables
from accessio.streaming.classify import identifier_stream

PAGE = """<html><table>
<tr><td>1</td><td><a href="furtherinfo.cfm?ncppb_no=45">NCPPB 45</a></td><td><i>Xanthomonas</i> campestris pv. citri</td></tr>
<tr><td><table><tr><td><strong>Country:</strong></td><td>Italy</td></tr><tr><td><strong>Host:</strong></td><td>Citrus &amp; lime</td></tr>
<tr><td><strong>Other references:</strong></td><td>ICMP 204,<br>LMG-673</td></tr>
<tr><td><strong>Host:</strong></td><td>Citrus</td></tr><tr><td><strong>Unknown:</strong></td><td>x</td></tr>
<tr><td><strong>Sequencing link:</strong></td><td><a href="/s/1">One</a> <a href="http://q/2"></a></td></tr></table></td></tr>
<tr><td>2</td><td><a href='furtherinfo.cfm?ncppb_no=46'>46</a></td><td>X. b</td></tr>
<tr><td><strong>Notes:</strong></td><td>none</td></tr>
<tr><td><a href="furtherinfo.cfm?ncppb_no=47">47</a></td></tr>
<tr><td>1</td><td><a href="furtherinfo.cfm?ncppb_no=45">no 45 again</a></td><td>other</td></tr>
</table></html>"""


def view_source(page):
    import html

    return "<table>" + "".join(f'<tr><td class="line-number">{i}</td><td class="line-content"><span>{html.escape(line)}</span></td></tr>' for i, line in enumerate(page.split("\n"))) + "</table>"


def test_tables_round_trip(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text('a,b,c\n"x ""q"" y",NA,\n"l1\nl2",None,7\n', encoding="utf-8")
    rows = tables.read_table(spark, str(source), ordinal="ord").orderBy("ord").drop("ord").collect()
    assert [tuple(r) for r in rows] == [('x "q" y', "NA", ""), ("l1\nl2", "None", "7")]
    rows = tables.read_table(spark, str(source), na_tokens=True).collect()
    assert {r.b for r in rows} == {""}
    df = spark.createDataFrame([('say "hi"', None)], "a string, b string")
    out = str(tmp_path / "out.tsv")
    tables.write_table(df.coalesce(1), out, ("b", "a", "z"))
    assert [tuple(r) for r in tables.read_table(spark, out).collect()] == [("", 'say "hi"', "")]
    text = "".join(p.read_text() for p in (tmp_path / "out.tsv").glob("part*"))
    assert text == 'b\ta\tz\n\t"say ""hi"""\t\n'
    assert tables.delimiter("X.TSV") == "\t" and tables.delimiter("x.csv") == ","


def test_bad_bytes_and_guards(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(b"a\xffb")
    assert tables.read_pages(spark, str(tmp_path / "p.html")).first().value == "a�b"
    with pytest.raises(ValueError):
        tables.required(spark.range(0), "rows")


def test_split_sink_is_null_safe(spark, tmp_path):
    df = spark.createDataFrame([("1", "yes"), ("2", None), ("3", "no")], "k string, v string")
    tables.split_sink(df, F.col("v") == "yes", str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert tables.read_table(spark, str(tmp_path / "a.csv")).count() == 1 and tables.read_table(spark, str(tmp_path / "b.csv")).count() == 2


def test_observed_counts(spark):
    df, seen = tables.observed(spark.range(10), "m", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_relational(spark):
    df = spark.createDataFrame([(0, "a", 1, "x"), (1, "a", 3, "y"), (2, "b", 2, "z"), (3, "a", 3, "w"), (4, "", 9, "v")], "ord int, k string, r int, v string")
    assert {(r.k, r.v) for r in relational.first_wins(df, ["k"], ["ord"]).collect()} == {("a", "x"), ("b", "z"), ("", "v")}
    assert {(r.k, r.v, r.ord) for r in relational.upsert_by_rank(df, ["k"], F.col("r"), "ord").collect()} == {("a", "y", 0), ("b", "z", 2), ("", "v", 4)}
    assert {r.k for r in relational.first_keys(df, "k", 1, "ord").collect()} == {"a"}
    assert relational.of_first_keys(df, "k", 0, "ord").count() == 5
    assert relational.first_wins(df.limit(0), ["k"], ["ord"]).count() == 0


def test_master(spark):
    rows = [(0, "b no digits", "X", "nan"), (1, "ncppb 100", "X pv. citri", "Italy"), (2, "9", "Y", ""), (3, "NCPPB 100", "late", ""), (4, None, "blank", "")]
    df = spark.createDataFrame(rows, "ord int, `NCPPB  no.` string, Taxon string, origin string")
    got = catalogue.master(df, "ord").collect()
    assert [(r.ncppb_number, r.ncppb_number_compact, r.current_name, r.pathovar, r.country) for r in got] == [("NCPPB 9", "NCPPB9", "Y", "", ""), ("NCPPB 100", "NCPPB100", "X pv. citri", "pv. citri", "Italy"), ("b no digits", "BNODIGITS", "X", "", ""), ("", "", "blank", "", "")]
    assert tuple(got[0].asDict()) == MASTER


def test_terms(spark):
    row = {c: "" for c in MASTER} | {"ncppb_number": "NCPPB 4 5", "ncppb_number_compact": "NCPPB45", "current_name": "X", "name_as_received": "Y", "alternative_names": "a|b", "other_collection_numbers": "ICMP 1; ICMP 1"}
    df = conform(spark.createDataFrame([row]), MASTER).withColumn("ord", F.lit(0))
    got = terms.search_terms(df, "ord").collect()
    assert tuple(got[0].asDict()) == SEARCH_TERMS
    assert [(r.term_type, r.search_term) for r in got] == [
        ("ncppb_number", "NCPPB 4 5"), ("ncppb_number_compact", "NCPPB45"), ("collection_name_plus_number", '"National Collection of Plant Pathogenic Bacteria" 45'), ("current_name_plus_number", '"X" "NCPPB 4 5"'),
        ("received_name_plus_number", '"Y" "NCPPB 4 5"'), ("alternative_name_plus_number", '"a" "NCPPB 4 5"'), ("alternative_name_plus_number", '"b" "NCPPB 4 5"'), ("other_collection_number", "ICMP 1"),
    ]
    assert terms.search_terms(df.limit(0), "ord").columns == list(SEARCH_TERMS)


@pytest.mark.parametrize("page", [PAGE, view_source(PAGE)])
def test_pages(spark, page):
    pages = spark.createDataFrame([("p", page)], "path string, value string")
    refs = catalogue.page_references(pages).collect()
    assert [tuple(r) for r in refs] == [("NCPPB 45", "ICMP 204, LMG-673"), ("NCPPB 46", ""), ("NCPPB 47", "")]
    got = {r.ncppb_number: r for r in catalogue.page_records(pages).collect()}
    assert set(got) == {"NCPPB 45", "NCPPB 46"}
    r = got["NCPPB 45"]
    assert (r.current_name, r.pathovar, r.country, r.host) == ("Xanthomonas campestris pv. citri", "pv. citri", "Italy", "Citrus")
    assert r.other_collection_numbers == "ICMP 204; LMG-673" and r.ncppb_catalogue_url.endswith("/furtherinfo.cfm?ncppb_no=45")
    assert r.catalogue_sequence_links == f"One <{catalogue.BASE_URL}s/1>; http://q/2" and got["NCPPB 46"].notes == "none"


def replay(spark):
    hits = spark.createDataFrame([("t1", "u1", 0), ("t1", "u2", 1), ("t1", "u3", 2), ("t4", "u1", 0)], "search_term string, uid string, place int")
    summary = json.dumps({"accession": "S1", "title": "T\tx", "organism": "Xanthomonas", "sampledata": "<A><Attribute harmonized_name='strain'>cab<b>ba</b>ge</Attribute></A>"})
    summaries = spark.createDataFrame([("u1", summary), ("u2", json.dumps({"sampledata": "<bad"}))], "uid string, summary string")
    errors = spark.createDataFrame([("t3", "timeout"), ("t4", "late")], "search_term string, error string")
    return lookup.ReplayLookup(hits, summaries, errors)


def test_replay(spark):
    specs = spark.createDataFrame([("n", "s", "i", "p", "x", t) for t in ("t1", "t2", "t3", "t4")], ", ".join(f"{c} string" for c in lookup.SPEC))
    rows = replay(spark).records(specs, most=2)
    assert tuple(rows.columns) == RAW_ROWS
    got = sorted((r.search_term, r.ncbi_uid, r.status, r.error, r.id_count_returned, r.attributes, r.source_url[-3:]) for r in rows.collect())
    assert got == [("t1", "u1", "ok", "", "3", "strain: cab ba ge", "/S1"), ("t1", "u2", "ok", "", "3", "", "/u2"), ("t2", "", "no_hit", "", "0", "", ""), ("t3", "", "error", "timeout", "", "", ""), ("t4", "", "error", "late", "", "", "")]


def test_documents(spark):
    df = spark.createDataFrame([('{"esearchresult": {"count": "7", "idlist": ["1", "2"]}}',), ("{}",)], "d string")
    assert [tuple(r.s) for r in df.select(lookup.search_result(F.col("d")).alias("s")).collect()] == [(7, ["1", "2"]), (0, [])]
    df = spark.createDataFrame([('{"result": {"uids": ["1"], "1": {"title": "a\tb"}}}',)], "d string")
    assert json.loads(df.select(lookup.summaries_of(F.col("d"))["1"].alias("s")).first().s, strict=False)["title"] == "a\tb"


def service_factory():
    """Local, so that workers get it by value."""

    class Answers:
        """Stands in for the network: three ids in pages, one summary, and a term that fails."""

        def __call__(self, url, timeout):
            from urllib.parse import parse_qs, urlsplit

            q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
            if q.get("term") == "bad":
                raise OSError("down")
            if "esearch" in url:
                ids = ["1", "2", "3"][int(q["retstart"]) : int(q["retstart"]) + int(q["retmax"])] if q["term"] == "good" else []
                body = {"esearchresult": {"count": "3" if q["term"] == "good" else "0", "idlist": ids}}
            else:
                body = {"result": {"uids": ["1"], "1": {"accession": "S1"}}}
            return io.BytesIO(json.dumps(body).encode())

    return lambda: lookup.Service(delay=0, opener=Answers())


def test_http_lookup(spark):
    make_service = service_factory()
    service = make_service()
    assert service.search("good", page=2) == (3, ["1", "2", "3"]) and service.requests == 2
    assert service.search("good", page=2, most=1) == (3, ["1"])
    specs = spark.createDataFrame([("n", "s", "i", "p", "x", t) for t in ("good", "none", "bad")], ", ".join(f"{c} string" for c in lookup.SPEC))
    rows = lookup.HttpLookup(make_service).records(specs)
    got = sorted((r.search_term, r.ncbi_uid, r.ncbi_accession, r.status, r.error) for r in rows.collect())
    assert got == [("bad", "", "", "error", "down"), ("good", "1", "S1", "ok", ""), ("good", "2", "", "ok", ""), ("good", "3", "", "ok", ""), ("none", "", "", "no_hit", "")]
    looked = spark.createDataFrame([("n", "k", "good", "sra"), ("n", "k", "bad", "sra")], ", ".join(f"{c} string" for c in TERM_RESULTS[:4]))
    assert report.lookup_summary(lookup.HttpLookup(make_service).terms(looked, most=2)).first().asDict() == {"ncbi_db": "sra", "n_lookups": 2, "n_with_ids": 1, "n_errors": 1, "n_ids": 2}


def test_query_specs(spark):
    rows = [(0, "NCPPB 45", "yes", "ICMP[All Fields] AND 1[All Fields]"), (1, "NCPPB 45", "no", ""), (2, "NCPPB 45", " YES", "ICMP[All Fields] AND 1[All Fields]"), (3, "", "yes", "Q"), (4, "none", "no", "")]
    df = spark.createDataFrame(rows, "ord int, ncppb_number string, include_for_search string, biosample_query string")
    df = df.withColumns({c: F.lit("i") for c in ("normalized_identifier", "prefix", "suffix")})
    got = [(r.ncppb_number, r.query_source, r.search_term) for r in lookup.query_specs(df, "ord").collect()]
    assert got == [("NCPPB 45", "ncppb_number", "NCPPB[All Fields] AND 45[All Fields]"), ("none", "ncppb_number", "NCPPB[All Fields] AND [All Fields]"), ("NCPPB 45", "other_reference", "ICMP[All Fields] AND 1[All Fields]")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", "ICMP 5"), ("2", "")], "ncppb_number string, other_references string").write.json(str(tmp_path / "in"))
    stream = identifier_stream(spark.readStream.schema("ncppb_number string, other_references string").json(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.rule_name for r in spark.table("found").collect()} == {"known_collection_prefix", "no_identifier_found"}


def test_files_count_in_the_order_of_their_names(spark, tmp_path):
    """Spark takes large files first; a small first one must still come first."""
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv" / "a.csv").write_text("k,v\nx,first\n")
    (tmp_path / "t.csv" / "b.csv").write_text("k,v\n" + "x,later\n" * 2000)
    (tmp_path / "t.csv" / "c.csv").write_text("k,v\nx,last\ny,c\n")
    rows = tables.read_table(spark, str(tmp_path / "t.csv"), ordinal="ord")
    assert [r.v for r in rows.orderBy("ord").select("v").collect()] == ["first", *["later"] * 2000, "last", "c"]
    assert {(r.k, r.v) for r in relational.first_wins(rows, ["k"], ["ord"]).collect()} == {("x", "first"), ("y", "c")}
    ranked = relational.upsert_by_rank(rows, ["k"], F.when(F.col("v") == "last", 2).otherwise(1), "ord")
    assert {(r.k, r.v) for r in ranked.collect()} == {("x", "last"), ("y", "c")}


def test_page_without_closing_tags(spark):
    """Ends of parents close what is open; rows are told apart by their parents, text by its tags."""
    page = (
        "<table><tr><td>1<td>x</td></td><td><a href='?furtherinfo.cfm'>no</a><a href='FurtherInfo.cfm?ncppb_no=7'></a></td><td> A <b>b</b>&amp;c &lt;<!-- y --> d</td>"
        "<table><tr><td>inner</td></tr></table></tr><!-- x --><tr><td><strong>Notes</strong><strong>Host: </strong></td><b>?</b><td>v1</td><td>v2</td></tr>"
        "<tr><td><strong>Host:</strong></td></tr></table>"
    )
    got = catalogue.records_of(page)
    assert [(r["ncppb_number"], r["current_name"], r["notes"], r["host"]) for r in got] == [("NCPPB 7", "A b &c < d", "v1", "v1")]
    assert got[0]["raw_record_text"].endswith("inner Notes Host: ? v1 v2") and catalogue.records_of("") == []


def test_replay_takes_repeated_terms_and_ids_once(spark):
    hits = spark.createDataFrame([("t", "u", 0)], "search_term string, uid string, place int")
    summaries = spark.createDataFrame([("u", '{"title": "a"}'), ("u", '{"title": "a"}')], "uid string, summary string")
    errors = spark.createDataFrame([("e", "x"), ("e", "y")], "search_term string, error string")
    specs = spark.createDataFrame([("n", "s", "i", "p", "x", t) for t in ("t", "e")], ", ".join(f"{c} string" for c in lookup.SPEC))
    got = sorted((r.search_term, r.title, r.error) for r in lookup.ReplayLookup(hits, summaries, errors).records(specs).collect())
    assert got == [("e", "", "x"), ("t", "a", "")]


def test_requests_are_counted_and_answers_kept(spark, tmp_path):
    looked = lookup.HttpLookup(service_factory())
    specs = spark.createDataFrame([("n", "s", "i", "p", "x", t) for t in ("good", "none", "bad", "none")], ", ".join(f"{c} string" for c in lookup.SPEC))
    out = looked.harvest(specs, str(tmp_path / "raw"), every=2, attempts=1)
    assert looked.requests == 4 and out.count() == 5 and tuple(out.columns) == RAW_ROWS  # 2 for good, 1 for none, 1 for bad
    assert looked.harvest(specs, str(tmp_path / "raw"), attempts=1).count() == 5 and looked.requests == 4


def test_plain_pages_are_parsed_once(monkeypatch):
    """Only what may be a view-source page is looked through for its line cells."""
    record = '<table><tr><td>1</td><td><a href="furtherinfo.cfm?ncppb_no=7">NCPPB 7</a></td><td>X &amp; y</td></tr></table>'
    line = record.replace("&", "&amp;").replace("<", "&lt;")
    want = catalogue.records_of(record)
    assert [r["current_name"] for r in want] == ["X & y"]
    for kind in ("line-content", "x line&#45;content", "line&#x2d;content"):
        assert catalogue.records_of(f'<table><tr><td class="{kind}">{line}</td></tr></table>') == want
    monkeypatch.setattr(catalogue, "_Lines", None)
    assert catalogue.records_of(record) == want


def test_plain_markup_gives_the_parsers_events(monkeypatch):
    """By one pattern or by the parser: the same records and lines; odd markup goes to the parser whole."""
    r = random.Random(3)
    plain = ["<td>", "</td>", "<tr>", "</tr>", "<table>", "</table>", '<td class="line-content">', "<td class='x line-content'>", '<a href="furtherinfo.cfm?ncppb_no=7">', "<a href=q id=3 >", "</a>", "<strong>", "</strong>", "Host:", "x &amp; y", "&lt;td&gt;", "&copy", "a > b", "<br>", "<BR />", "<TD colspan=3>", "<a href>", '<a href="">', "\n"]
    odd = ["<!-- c -->", "<", "</", "<script>", "</script>", '<a href="a&amp;b">', "<td/class='line-content'>", "<td\x0bclass='line-content'>", "<p/>", '</td x="1">', "\x00"]
    read = lambda page: [(x.strings, x.links, getattr(x, "found", None), getattr(x, "lines", None)) for x in (catalogue._Records().read(page), catalogue._Lines().read(page))]
    pages = ["".join(r.choices(plain + odd * (i % 2), k=r.randrange(1, 25))) for i in range(2000)]
    assert all(catalogue._Records()._plain(p) for p in pages[::2]) and not all(catalogue._Records()._plain(p) for p in pages)
    got = [read(p) for p in pages]
    monkeypatch.setattr(catalogue._Events, "_plain", lambda self, html: False)
    assert got == [read(p) for p in pages]
