import pytest
from factloom.sources import structure as S

JAVA = '''package shop.orders;

import java.util.List;

/* class Ghost { */
@Service("a { b")
public class Orders extends Base<String> {
  private static final int A = 1, B = f(2, 3);
  @Value("${orders.limit:5}")
  private Map<String, List<Integer>> limits = new HashMap<>();
  int[] sizes = {1, 2};

  public Orders(int a, Map<String, Integer> b) {
    this.a = a; // }
  }

  @Test
  void place() throws IOException {
    String s = "}{";
    if (a > 1) { run(() -> { go(); }); }
    for (int i = 0; i < 3; i++) { go(); }
  }

  public static class Line {
    char c = '{';
    interface Visitor<T> {
      T visit(Line line, int... more);
    }
    enum State { OPEN, DONE }
  }

  protected abstract <T> T last(T x);
}
'''
KOTLIN = '''package shop

import a.b.C as D

val top = 1

@Service
data class Item(val id: Int)

class Shop(private val items: List<Item>) :
    Base() {
    private val limit: Int = 3
    companion object {
        fun make(a: Int, b: Map<String, Int>): Shop = Shop(listOf())
    }

    @Test
    fun `x`() {}

    @GetMapping("/a")
    suspend fun List<Item>.total(
        a: Int,
    ): Int {
        val local = 2
        return "${local} }".length
    }
}

fun helper() = 1
'''
TYPESCRIPT = '''import { A } from "./a";

export interface Shape { area(): number }

@Controller("items")
export class Items {
  private readonly limit: number = 3;
  name = "x"

  constructor(private readonly a: A, b: string) {}

  @Get(":id")
  async find(id: string): Promise<void> {
    if (id) { return; }
    const inner = (x: number) => { return x; };
  }
}

export function top(a: number, b = { c: 1 }): void {
  go();
}

export const arrow = async (a: string) => {
  return a;
};

describe("items", () => {
  it("finds one", async () => {
    expect(1).toBe(1);
  });
});
'''


def rows(spark, language, content):
    df = S.declared(spark.createDataFrame([("f", language, content)], "path string, language string, content string"))
    got = df.collect()
    names = {r["id"]: r["name"] for r in got}
    return {(r["kind"], r["name"]): (r["start_line"], r["end_line"], names.get(r["owner"]), r["arity"]) for r in got}, got


def test_java(spark):
    got, all_ = rows(spark, "java", JAVA)
    assert got == {
        ("package", "shop.orders"): (1, 1, None, None),
        ("class", "Orders"): (6, 33, None, None),
        ("field", "A"): (8, 8, "Orders", None),
        ("field", "B"): (8, 8, "Orders", None),
        ("field", "limits"): (9, 10, "Orders", None),
        ("field", "sizes"): (11, 11, "Orders", None),
        ("constructor", "Orders"): (13, 15, "Orders", 2),
        ("method", "place"): (17, 22, "Orders", 0),
        ("test", "place"): (17, 22, "place", 0),
        ("class", "Line"): (24, 30, "Orders", None),
        ("field", "c"): (25, 25, "Line", None),
        ("interface", "Visitor"): (26, 28, "Line", None),
        ("method", "visit"): (27, 27, "Visitor", 2),
        ("class", "State"): (29, 29, "Line", None),
        ("method", "last"): (32, 32, "Orders", 1),
    }
    by = {(r["kind"], r["name"]): r for r in all_}
    assert by["method", "visit"]["qualified_name"] == "shop.orders.Orders.Line.Visitor.visit"
    notes = {(r["name"], r["arguments"], r["configuration_key"]) for r in S.annotations(spark.createDataFrame(all_)).collect()}
    assert notes == {("Service", '"a { b"', None), ("Value", '"${orders.limit:5}"', "orders.limit"), ("Test", None, None)}


def test_kotlin(spark):
    got, all_ = rows(spark, "kotlin", KOTLIN)
    for key, want in {
        ("package", "shop"): (1, 1, None, None),
        ("field", "top"): (5, 5, None, None),
        ("class", "Item"): (7, 8, None, None),
        ("class", "Shop"): (10, 27, None, None),
        ("field", "limit"): (12, 12, "Shop", None),
        ("object", "Companion"): (13, 15, "Shop", None),
        ("method", "make"): (14, 14, "Companion", 2),
        ("method", "total"): (20, 26, "Shop", 1),
        ("function", "helper"): (29, 29, None, 0),
    }.items():
        assert got[key] == want, key
    assert ("field", "local") not in got
    assert {r["name"]: r["notes"] for r in all_}["total"] == ['@GetMapping("/a")']


def test_typescript(spark):
    got, all_ = rows(spark, "typescript", TYPESCRIPT)
    for key, want in {
        ("interface", "Shape"): (3, 3, None, None),
        ("class", "Items"): (5, 17, None, None),
        ("field", "limit"): (7, 7, "Items", None),
        ("field", "name"): (8, 8, "Items", None),
        ("constructor", "Items"): (10, 10, "Items", 2),
        ("method", "find"): (12, 16, "Items", 1),
        ("function", "inner"): (15, 15, "find", 1),
        ("function", "top"): (19, 21, None, 2),
        ("function", "arrow"): (23, 25, None, 1),
        ("test", "items"): (27, 31, None, None),
        ("test", "finds one"): (28, 30, "items", None),
    }.items():
        assert got[key] == want, key
    assert {r["name"]: r["notes"] for r in all_}["find"] == ['@Get(":id")']


@pytest.mark.parametrize("content,want", [
    ("class A { void f() { } }", set()),
    ("class A {\n void f() {\n}\n", {(1, "{ is never closed")}),
    ("class A { }\n}\n", {(2, "} closes nothing")}),
    ("class A {\n int f = g(1];\n}", {(2, "] closes ( of line 2")}),
    ('class A {\n String s = "open;\n}', {(2, "a string without an end")}),
    ("class A { }\n/* no end", {(2, "a comment without an end")}),
    ("", set()),
])
def test_syntax(spark, content, want):
    df = spark.createDataFrame([("f", "java", content), ("n", "java", None)], "path string, language string, content string")
    assert {(r["line"], r["message"]) for r in S.syntax_diagnostics(df).collect()} == want


def test_long_files_and_odd_rows(spark):
    body = "\n".join(f"  void m{i}() {{ if (x) {{ go(); }} }}" for i in range(3000))
    df = spark.createDataFrame([("f", "java", f"class A {{\n{body}\n}}\n"), ("g", "java", None), ("h", None, "class X {}"), ("i", "java", '"' + "\\\\" * 3000)], "path string, language string, content string")
    got = S.declared(df)
    assert got.where("kind = 'method' and owner like 'f#0#class#A'").count() == 3000
