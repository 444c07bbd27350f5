"""Texts and hosts that once took quadratic time or memory."""

import time

from siftline.llm import secret_scan, url_filter


def test_repeated_heads_of_a_token_take_linear_time(spark):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    texts = ["eyJ" * 300_000 + " .eyJ", "-eyJ" * 200_000, f"x {token} y", f"a{token}", f"-{token}", f"{token}.eyJab.cd {token}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "jwt"] for r in secret_scan.find_secrets(docs).collect()}
    assert time.time() - began < 60
    n = len(token)
    assert found == {0: [], 1: [], 2: [(2, 2 + n)], 3: [], 4: [], 5: [(0, n), (n + 10, 2 * n + 10)], 6: []}


def test_hosts_of_many_labels_ask_for_few_suffixes(spark):
    host = ".".join(f"l{k}" for k in range(40_000)) + ".bad.net"
    pages = spark.createDataFrame([(1, f"http://{host}/x/y"), (2, "http://a.bad.net/"), (3, "http://good.net/x/")], "page_id long, url string")
    assert len(list(url_filter.candidates(host, "/x/y", [0, 1], 3))) == 6
    limit, url_filter.FILE_BYTES = url_filter.FILE_BYTES, url_filter.FILE_BYTES
    try:
        for size in (limit, 1):
            url_filter.FILE_BYTES = size
            out = {r.page_id: r.verdict for r in url_filter.judge(pages, ["bad.net", "good.net/x/y/"]).collect()}
            assert out == {1: "block", 2: "block", 3: "allow"}
    finally:
        url_filter.FILE_BYTES = limit
