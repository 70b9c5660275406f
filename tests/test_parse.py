"""Golden lines (FIXTURES.md section 2) through the column-expression parser."""

from authlytics.functions.parse import parse_lines

GOLDEN = [
    ("auth_log", "Mar  7 03:05:09 gate sshd[881]: Failed password for backup from 198.18.4.20 port 41001 ssh2",
     ("login_failed", "backup", "198.18.4.20", 41001, "password")),
    ("auth_log", "Mar 17 08:11:40 gate sshd[882]: Accepted publickey for dora from 198.18.4.21 port 41002 ssh2",
     ("login_success", "dora", "198.18.4.21", 41002, "publickey")),
    ("auth_log", "Mar 17 08:12:00 gate sudo: dora : TTY=pts/3 ; PWD=/srv/app ; USER=root ; COMMAND=/usr/bin/apt update",
     ("sudo_success", "dora", None, None, "sudo")),
    ("auth_log", "Apr  2 22:00:01 gate sshd[883]: Invalid user guest7 from 198.18.4.22 port 41003",
     ("invalid_user_attempt", "guest7", "198.18.4.22", 41003, "password")),
    ("auth_log", "Apr  2 22:00:02 gate sshd[884]: Failed password for invalid user guest7 from 198.18.4.22 port 41004",
     ("login_failed", "invalid user guest7", "198.18.4.22", 41004, "password")),
    ("auth_log", "Apr  2 22:01:30 gate sudo: ivan : command not allowed ; TTY=pts/1 ; PWD=/opt",
     ("sudo_failure", "ivan", None, None, "sudo")),
    ("auth_log", "Apr  2 22:02:00 gate sshd[885]: Disconnected from 198.18.4.22 port 41004",
     ("unknown", None, None, None, "unknown")),
    ("audit_log", 'type=EXECVE msg=audit(1711963200.250:77): argc=2 exe="/usr/bin/rsync"',
     ("process_execution", None, None, None, "exec")),
]
DROPPED = [("audit_log", "type=SYSCALL msg=audit(1.0:1): x=1"), ("auth_log", ""), ("syslog", "   "),
           ("audit_log", "no type here")]


def test_golden_lines(spark):
    rows = [(i, src, line) for i, (src, line, _) in enumerate(GOLDEN)]
    rows += [(100 + i, src, line) for i, (src, line) in enumerate(DROPPED)]
    df = spark.createDataFrame(rows, "event_id long, source string, value string")
    out = {r["event_id"]: r for r in parse_lines(df, year=2024).collect()}
    assert set(out) == set(range(len(GOLDEN)))
    for i, (_, _, exp) in enumerate(GOLDEN):
        r = out[i]
        assert (r["event_type"], r["username"], r["source_ip"], r["source_port"], r["auth_method"]) == exp


def test_event_time_and_message(spark):
    df = spark.createDataFrame([(0, "auth_log", GOLDEN[0][1]), (1, "audit_log", GOLDEN[7][1])],
                               "event_id long, source string, value string")
    out = {r["event_id"]: r for r in parse_lines(df, year=2024).collect()}
    assert out[0]["event_time"].strftime("%Y-%m-%d %H:%M:%S") == "2024-03-07 03:05:09"
    assert out[1]["message"] == "Executed: /usr/bin/rsync"
    assert out[1]["service"] == "auditd"


def test_text_source_roundtrip(spark, tmp_path):
    from authlytics.sources.text_logs import ingest_all
    (tmp_path / "auth.log").write_text("\n".join(line for src, line, _ in GOLDEN if src == "auth_log") + "\n\n")
    (tmp_path / "audit.log").write_text(GOLDEN[7][1] + "\n" + DROPPED[0][1] + "\n")
    ev = ingest_all(spark, {"auth_log": str(tmp_path / "auth.log"), "audit_log": str(tmp_path / "audit.log")})
    kinds = sorted(r["event_type"] for r in ev.collect())
    assert kinds == sorted(exp[0] for _, _, exp in GOLDEN)


def test_separator_in_a_line_forges_nothing(spark):
    line = "Mar  7 03:05:09 gate sshd[881]: Failed password for a\u0001198.51.100.8\u000122 from 198.18.4.20 port 41001 ssh2"
    r = parse_lines(spark.createDataFrame([(1, "auth_log", line)], "event_id long, source string, value string")).first()
    assert (r["source_ip"], r["source_port"], r["raw_line"]) == ("198.18.4.20", 41001, line)


def test_unreadable_stamps_and_years(spark):
    import datetime as dt
    line = "{} gate sshd[881]: Failed password for backup from 198.18.4.20 port 41001 ssh2"
    rows = [(0, "Feb 29 01:02:03"), (1, "Xyz 12 01:02:03"), (2, "Dec 31 23:59:00"), (3, "Jan  1 00:30:00")]
    df = spark.createDataFrame([(i, "auth_log", line.format(s), dt.datetime(2023, 1, 1, 1, 0)) for i, s in rows],
                               "event_id long, source string, value string, ingest_time timestamp")
    fixed = {r["event_id"]: r["event_time"] for r in parse_lines(df, year=2023).collect()}
    assert fixed[0] is None and fixed[1] is None
    inferred = {r["event_id"]: r["event_time"] for r in parse_lines(df, year=None).collect()}
    assert inferred[2].year == 2022 and inferred[3].year == 2023


def test_one_match_per_line(spark):
    df = spark.createDataFrame([(0, "auth_log", "x")], "event_id long, source string, value string")
    plan = parse_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Accepted") + plan.count("[Aa]ccepted") <= 3      # test and groups of one CASE


def test_row_keys_are_unique_over_sources(spark, tmp_path):
    from authlytics.sources.text_logs import read_sources
    for n in ("auth", "sys"):
        (tmp_path / f"{n}.log").write_text("a\nb\nc\n")
    df = read_sources(spark, {"auth_log": str(tmp_path / "auth.log"), "syslog": str(tmp_path / "sys.log")})
    assert df.select("event_id").distinct().count() == 6


def test_baseline_rows_keep_flags_and_ids(spark, tmp_path):
    from authlytics.sources.text_logs import read_baseline_jsonl
    (tmp_path / "b.jsonl").write_text('{"event_id": "x_y_1", "user_new_ip_detected": true, "ip_failed_logins": 3}\n'
                                      '{"event_id": 7, "user_new_ip_detected": 0, "ip_failed_to_success_ratio": 0.5}\n')
    got = {r["event_id"]: r for r in read_baseline_jsonl(spark, str(tmp_path / "b.jsonl")).collect()}
    assert got["x_y_1"]["user_new_ip_detected"] == 1.0 and got["x_y_1"]["ip_failed_logins"] == 3.0
    assert got["7"]["user_new_ip_detected"] == 0.0 and got["7"]["ip_failed_to_success_ratio"] == 0.5
