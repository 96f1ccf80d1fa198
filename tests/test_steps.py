"""The command lines, from saved pages to accepted and reviewed rows."""

import json

import pytest

from accessio.__main__ import main
from accessio.sources import paged, tables


def record(number, name, references):
    return (
        f'<tr><td>x</td><td><a href="furtherinfo.cfm?ncppb_no={number}">NCPPB {number}</a></td><td>{name}</td></tr>'
        f"<tr><td colspan=3><table><tr><td><strong>Other references:</strong></td><td>{references}</td></tr></table></td></tr>"
    )


@pytest.fixture
def step(spark, capsys):
    def run(*argv):
        capsys.readouterr()
        code = main([str(a) for a in argv], spark)
        out, err = capsys.readouterr()
        return json.loads(out) if code == 0 else err.strip()

    return run


def search(ids, total=None):
    return json.dumps({"esearchresult": {"count": str(len(ids) if total is None else total), "idlist": ids}})


def test_all_steps(spark, step, tmp_path):
    where = lambda name: tmp_path / name
    page = "<table>" + record(45, "Xanthomonas citri pv. citri", "ICMP 204, LMG-673") + record(46, "Xanthomonas x", "") + record(47, "Xanthomonas y", "isolated by A. Brown B9") + "</table>"
    where("page.html").write_text(page)
    assert step("records", "--input", where("page.html"), "--output", where("records.csv")) == {"rows": 3}
    assert step("master", "--input", where("records.csv"), "--output", where("master.csv")) == {"rows": 3}
    made = step("terms", "--input", where("master.csv"), "--output", where("terms.tsv"))
    assert made["rows"] == tables.read_table(spark, str(where("terms.tsv"))).count() > 9
    assert step("references", "--input", where("page.html"), "--output", where("references.tsv")) == {"rows": 3, "filled": 2}
    assert step("identifiers", "--input", where("references.tsv"), "--output", where("identifiers.csv")) == {"rows": 4, "included": 3, "rejected": 0, "empty": 1}
    assert step("identifiers", "--input", where("references.tsv"), "--output", where("some.csv"), "--drop-empty-rows", "--large") == {"rows": 3, "included": 3, "rejected": 0, "empty": 0}

    term = lambda *words: " AND ".join(f"{w}[All Fields]" for w in words)
    known = {term("NCPPB", 45): ["1", "2"], term("NCPPB", 46): [], term("NCPPB", 47): ["3"], term("ICMP", 204): ["1"], term("LMG", 673): [], term("B", 9): ["3"]}
    summaries = {"1": {"accession": "S1", "organism": "Xanthomonas citri", "title": "strain NCPPB 45"}, "2": {"organism": "Xanthomonas citri", "title": "NCPPB 99"}, "3": {"organism": "Xanthomonas", "title": "isolate B 9"}}
    rows = [(f"esearch|biosample|{t}|{at}|1", search(ids[at : at + 1], len(ids))) for t, ids in known.items() for at in range(max(1, len(ids)))]
    rows += [(f"esummary|biosample|{i}", json.dumps({"result": {"uids": [i], i: s}})) for i, s in summaries.items()]
    looked = [t.search_term for t in tables.read_table(spark, str(where("terms.tsv"))).where("ncppb_number = 'NCPPB 45'").collect()]
    rows += [(f"esearch|{db}|{t}|0|5", search(["7", "8"] if db == "sra" else [])) for t in looked for db in ("biosample", "assembly", "sra", "taxonomy")]
    paged.record_answers(spark.createDataFrame(rows, "request string, answer string"), str(where("answers")))

    ask = ("--delay", "0", "--answers", where("answers"))
    assert step("lookups", "--input", where("terms.tsv"), "--output", where("ids.tsv"), "--limit-strains", 1, *ask) == {"rows": 4 * len(looked), "with_ids": len(looked), "errors": 0, "requests": 4 * len(looked)}
    harvested = step("harvest", "--input", where("identifiers.csv"), "--output", where("raw.csv"), "--retmax", 1, "--summary-batch-size", 1, "--tasks", 2, "--attempts", 1, *ask)
    assert harvested == {"rows": 7, "ok": 5, "no_hit": 2, "error": 0, "requests": 7 + 5}
    again = step("harvest", "--input", where("identifiers.csv"), "--output", where("raw.csv"), "--retmax", 1, "--summary-batch-size", 1, *ask)
    assert again == harvested | {"requests": 0}  # the log has all answers
    few = step("harvest", "--input", where("identifiers.csv"), "--output", where("few.csv"), "--limit-strains", 1, "--no-ncppb-number", "--retmax", 1, "--summary-batch-size", 1, *ask)
    assert few == {"rows": 2, "ok": 1, "no_hit": 1, "error": 0, "requests": 3}
    decided = step("classify", "--raw-input", where("raw.csv"), "--identifiers", where("identifiers.csv"), "--matches-output", where("matches.tsv"), "--review-output", where("review.tsv"))
    assert decided == {"rows": 7, "accept": 2, "review": 2, "reject": 1, "no_data": 2}
    assert tables.read_table(spark, str(where("matches.tsv"))).count() == 2 and tables.read_table(spark, str(where("review.tsv"))).count() == 5


def test_tables_without_rows(step, tmp_path):
    (tmp_path / "empty.csv").write_text("ncppb_number,other_references\n")
    assert step("identifiers", "--input", tmp_path / "empty.csv", "--output", tmp_path / "out.csv").startswith("no references in ")
    for name in ("identifiers", "records", "terms"):
        assert step(name, "--input", tmp_path / "none.csv", "--output", tmp_path / "out.csv").startswith("input not found: ")
    with pytest.raises(SystemExit):
        main(["identifiers", "--output", "x"])
