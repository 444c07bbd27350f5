from pyspark.sql import functions as F

from siftline.sources import braces, structure, surface

JAVA = '''package com.acme.web;
import java.util.List;
import static org.x.Y.*;

/* class Ghost { void no() { a(); } } */
@RestController
@RequestMapping(value = "/api")
public class Users<T extends Comparable<T>> extends Base implements Runnable {
    private final List<String> names = new java.util.ArrayList<>(); // call();
    String text = "class Fake { \\" }";
    Runnable r = () -> { helper.run("x", 1); };
    @GetMapping("/users/{id}")
    public <R> List<R> find(@PathVariable("id") int id) throws IOException, Other {
        if (id > 0) { return repo.load(id).map(x -> trim(x)); }
        switch (id) { case 1: break; }
        char c = '{';
        String s = """
            void nope() { zap(); }
            """;
        return null;
    }
    Users(int a) { super(a); init(); }
    interface Inner { int size(String key); }
    @KafkaListener(topics = "orders", groupId = "g")
    void on(String m) { new Handler().handle(m); }
    @Scheduled(fixedRate = 5000)
    void tick() {}
    enum Color { RED, GREEN; int code() { return ordinal(); } }
}
@DubboService
class Pay implements PayApi {}
'''
GO = '''package main

import (
    "fmt"
    web "github.com/gin-gonic/gin"
)
import "os"

// func ghost() {}
type Server[T any] struct {
    run func(int) error
}
type Store interface { Get(k string) string }

func (s *Server[T]) Start(port int) (err error) {
    fmt.Println(`raw { "x`, port)
    for i := 0; i < 3; i++ { go s.loop(i) }
    return func() error { return s.close() }()
}

func Map[T any, U any](in []T, f func(T) U) []U { return apply(in, f) }

func handler() interface{} { return nil }

func main() {
    r := web.Default()
    r.GET("/ping", ping)
    v1 := r.Group("/v1")
    v1.POST("/login", auth.Login)
    http.HandleFunc("/old", old)
    c.AddFunc("@daily", clean)
}
'''


def rows(found, kind):
    return [(n, o, line) for k, n, o, line, _ in found if k == kind]


def test_java():
    found = list(braces.java(JAVA))
    assert rows(found, "package") == [("com.acme.web", "", 1)]
    assert [n for n, _, _ in rows(found, "import")] == ["java.util.List", "org.x.Y.*"]
    assert rows(found, "class") == [("Users", "", 8), ("Users.Inner", "Users", 23), ("Users.Color", "Users", 28), ("Pay", "", 31)]
    assert rows(found, "function") == [("Users.find", "Users", 13), ("Users.Users", "Users", 22), ("Users.Inner.size", "Users.Inner", 23), ("Users.on", "Users", 25), ("Users.tick", "Users", 27), ("Users.Color.code", "Users.Color", 28)]
    calls = rows(found, "call")
    assert ("helper.run", "Users", 11) in calls and ("repo.load", "Users.find", 14) in calls and ("trim", "Users.find", 14) in calls and ("init", "Users.Users", 22) in calls
    assert ("ordinal", "Users.Color.code", 28) in calls and ("Handler", "Users.on", 25) in calls
    assert not {n for n, _, _ in calls} & {"zap", "a", "call", "if", "switch", "super"}


def test_go():
    found = list(braces.go(GO))
    assert [(n, d) for k, n, _, _, d in found if k == "import"] == [("fmt", ""), ("github.com/gin-gonic/gin", "web"), ("os", "")]
    assert rows(found, "class") == [("Server", "", 10), ("Store", "", 13)]
    assert rows(found, "function") == [("Server.Start", "Server", 15), ("Map", "", 21), ("handler", "", 23), ("main", "", 25)]
    calls = rows(found, "call")
    assert {("fmt.Println", "Server.Start", 16), ("s.loop", "Server.Start", 17), ("s.close", "Server.Start", 18), ("apply", "Map", 21), ("r.GET", "main", 27), ("web.Default", "main", 26)} <= set(calls)


def test_entry_points_of_both_and_the_cascade(spark):
    files = spark.createDataFrame([("U.java", JAVA), ("m.go", GO), ("n.java", None), ("x.txt", "class A {}")], "path string, content string")
    found = {tuple(r)[2:] for r in braces.brace_entry_points(braces.brace_structure(files)).collect()}
    assert found == {
        ("http", "spring", "GET", "/api/users/{id}", "find"),
        ("mq", "kafka", None, "orders", "on"),
        ("cron", "spring", None, "5000", "tick"),
        ("rpc", "dubbo", None, "Pay", "Pay"),
        ("http", "gin", "GET", "/ping", "ping"),
        ("http", "gin", "POST", "/v1/login", "Login"),
        ("http", "net/http", "ANY", "/old", "old"),
        ("cron", "cron", None, "@daily", "clean"),
    }
    tiers = {(r.path, r.tier) for r in surface.cascade(files, braces.brace_entry_points(braces.brace_structure(files))).collect()}
    assert tiers == {("U.java", "syntax"), ("m.go", "syntax")}


def test_long_deep_and_broken_files(spark):
    deep = "class A { void f() " + "{" * 50_000 + "g();" + "}" * 50_000 + " void h() { k(); } }"
    found = list(braces.java(deep))
    assert ("function", "A.h", "A", 1, "") in found and ("call", "k", "A.h", 1, "") in found
    long = "package p\n" + "".join(f"func f{k}() {{ g{k}() }}\n" for k in range(20_000))
    assert sum(r[0] == "function" for r in braces.go(long)) == 20_000
    for broken in ("class A { void f( {", 'class A { String s = "x', "/* never", "func (", "func f(", "import (", "type X [", "}}}}", "@A(", "class", "func (r *T) M() {"):
        list(braces.java(broken)), list(braces.go(broken))


def test_many_small_files_of_one_split_are_parsed_by_many_tasks_in_few_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    files = spark.range(200).select(F.concat(F.lit("p/C"), "id", F.lit(".java")).alias("path"), F.concat(F.lit("class C"), "id", F.lit(" {\n void a() { b(); } }")).alias("content")).coalesce(1)
    rows = braces.brace_structure(files).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() > 1
    found = rows.groupBy("kind", "line").count().collect()
    assert {(r["kind"], r["line"], r["count"]) for r in found} == {("class", 1, 200), ("function", 2, 200), ("call", 2, 200)}
    # batches that end inside a file lose nothing
    monkeypatch.setattr(braces, "ROWS", 7)
    assert braces.brace_structure(files).count() == 600


def test_no_side_that_grows_with_files_is_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    cut = structure._cut
    monkeypatch.setattr(structure, "_cut", lambda df: plan(df) or cut(df))
    k = F.col("id").cast("string")
    text = F.concat(F.lit("package p; import p.A0; class A"), k, F.lit(" { void m0() { m1(); A0.m1(); } void m1() { } }"))
    files = spark.range(500).select(F.concat(F.lit("src/p/A"), k, F.lit(".java")).alias("path"), text.alias("content"))
    edges = structure.call_graph(braces.brace_structure(files))[1]
    plan(edges)
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert edges.count() == 999
