from siftline.sources import braces, structure


def edges(df):
    return {(r.src, r.dst) for r in structure.call_graph(df)[1].collect()}


FILES = {
    "app/main.py": "from lib import tool\nimport lib.deep as d\nfrom lib.deep import helper as h\nfrom lib.stars import *\nfrom . import near\n\ndef run():\n    tool()\n    d.helper()\n    h()\n    shiny()\n    near.close()\n    local()\n    lib.deep.other()\n    lonely()\n    missing()\n\ndef local():\n    pass\n",
    "app/near.py": "def close():\n    pass\ndef helper():\n    pass\n",
    "app/__init__.py": "",
    "lib/__init__.py": "from .deep import tool\nfrom .ring import loop\n",
    "lib/ring.py": "from . import loop\n\ndef spin():\n    loop()\n",
    "lib/deep.py": "def tool():\n    return helper()\ndef helper():\n    pass\ndef other():\n    pass\nclass C:\n    def m(self):\n        return self.n()\n    def n(self):\n        return helper()\n",
    "lib/stars.py": "def shiny():\n    pass\ndef local():\n    pass\n",
    "far/x.py": "def lonely():\n    pass\ndef tool():\n    pass\ndef n():\n    pass\n",
}


def test_python_calls_go_through_imports(spark):
    df = structure.python_structure(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    run, deep = "app/main.py:run", "lib/deep.py"
    assert edges(df) == {
        (run, f"{deep}:tool"),
        (run, f"{deep}:helper"),
        (run, f"{deep}:other"),
        (run, "lib/stars.py:shiny"),
        (run, "app/near.py:close"),
        (run, "app/main.py:local"),
        (run, "far/x.py:lonely"),
        (f"{deep}:tool", f"{deep}:helper"),
        (f"{deep}:C.m", f"{deep}:C.n"),
        (f"{deep}:C.n", f"{deep}:helper"),
    }


def test_java_and_go_calls(spark):
    files = [
        ("a/Main.java", "package a; import b.Util; import static c.Fix.*; class Main { void go() { Util.help(); Near.by(); mend(); this.own(); } void own() {} }"),
        ("a/Near.java", "package a; class Near { static void by() {} static void help() {} }"),
        ("b/Util.java", "package b; class Util { static void help() {} }"),
        ("c/Fix.java", "package c; class Fix { static void mend() {} } class Other { static void mend() {} }"),
        ("cmd/main.go", 'package main\nimport "h.org/x/store"\nimport s2 "h.org/x/cache"\nfunc main() { store.Open(); s2.Open(); run() }\nfunc run() {}\n'),
        ("store/open.go", "package store\nfunc Open() { load() }\n"),
        ("store/load.go", "package store\nfunc load() {}\n"),
        ("cache/open.go", "package cache\nfunc Open() {}\nfunc run() {}\n"),
    ]
    df = braces.brace_structure(spark.createDataFrame(files, "path string, content string"))
    go = "a/Main.java:Main.go"
    assert edges(df) == {
        (go, "b/Util.java:Util.help"),
        (go, "a/Near.java:Near.by"),
        (go, "c/Fix.java:Fix.mend"),
        (go, "a/Main.java:Main.own"),
        ("cmd/main.go:main", "store/open.go:Open"),
        ("cmd/main.go:main", "cache/open.go:Open"),
        ("cmd/main.go:main", "cmd/main.go:run"),
        ("store/open.go:Open", "store/load.go:load"),
    }
