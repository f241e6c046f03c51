"""Log records across block bounds, against a plain reading of the same files."""

import os
import re
import tempfile

from mdloom.sources import log_records as LR

HEAD = re.compile(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d - \S+ - (\w+) - ")


def _plain(text):
    out, head = [], None
    for no, line in enumerate(text.split("\n")[:-1], 1):
        if HEAD.match(line):
            head = (no, line)
        out.append((no, line, head and head[0], head and head[1]))
    return out


def test_records_across_blocks(spark):
    folder = tempfile.mkdtemp(prefix="mdloom-logs-", dir="/tmp")
    one = "".join(f"2024-01-01 00:00:{i % 60:02d} - web - {'ERROR' if i % 3 else 'INFO'} - m | url=https://a/{i} | attempt={i}\n"
                  + "".join(f"  at line {k}\n" for k in range(i * 7 % 40)) for i in range(200))
    texts = {"one.log": "before any head\n\n" + one, "two.log": "  only a trace\n" * 300, "three.log": "", "four.log": one[: len(one) // 2] + "\n"}
    for name, t in texts.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(t)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")   # traces run over several blocks
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = LR.read_lines(spark, folder)
        assert lines.select("file", "block").distinct().count() > 30
        rows = LR.with_heads(lines)
        got = sorted((os.path.basename(r.file), r.line_no, r.value, r.head_line, r["head"]) for r in rows.collect())
        want = sorted(((n, *row) for n, t in texts.items() for row in _plain(t)), key=lambda r: (r[0], r[1]))
        assert got == want
        errors = LR.error_lines(rows, "https://a/5")
        records = LR.error_records(errors)
        found = {(os.path.basename(r.file), r.head_line): (r.level, r.ctx["attempt"], r.n_lines, r.last_line) for r in records.collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    expect = {}
    for n, t in texts.items():
        groups = {}
        for no, line, hl, h in _plain(t):
            groups.setdefault((hl, h), []).append(line)
        for (hl, h), ls in groups.items():
            if h and HEAD.match(h).group(1) == "ERROR" and any("https://a/5" in x for x in ls):
                expect[(n, hl)] = ("ERROR", h.rsplit("attempt=", 1)[1], len(ls), ls[-1])
    assert found == expect and len(found) > 5


def test_empty_folder_of_logs(spark):
    folder = tempfile.mkdtemp(prefix="mdloom-logs-", dir="/tmp")
    open(os.path.join(folder, "empty.log"), "w").close()
    assert LR.error_records(LR.error_lines(LR.with_heads(LR.read_lines(spark, folder)))).count() == 0
