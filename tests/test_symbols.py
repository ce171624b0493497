import sys
from pathlib import Path

from factloom.sources import enrichment as E
from factloom.sources import structure as S
from factloom.sources import symbols as Y

sys.path.insert(0, str(Path(__file__).parent))
from plan_rows import most_rows  # noqa: E402


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, language string, content string")


def test_every_visibility(spark):
    known = spark.createDataFrame(
        [("1", "class", "A", "p.A", "p", None, None), ("2", "class", "A", "q.A", "q", None, None), ("3", "class", "B", "r.B", "r", None, None), ("4", "method", "run", "p.A.run", "p", "p.A", 1), ("5", "method", "run", "p.A.run", "p", "p.A", 2), ("6", "method", "run", "p.C.run", "p", "p.C", 1), ("7", "constructor", "A", "p.A.A", "p", "p.A", 0)],
        "id string, kind string, name string, qualified_name string, package string, owner_name string, arity int",
    )
    imports = spark.createDataFrame([("x", "r.B", False, None), ("x", "q", True, None), ("y", "r.B", False, "Other"), ("z", "q.A", False, None)], "path string, qualified_name string, wildcard boolean, alias string")
    asks = [
        ("import", "x", "n", "B", "type", None, None), ("wildcard", "x", "n", "A", "type", None, None), ("package", "u", "p", "A", "type", None, None),
        ("alias", "y", "n", "Other", "type", None, None), ("ambiguous", "x", "p", "A", "type", None, None), ("exact", "u", "n", "q.A", "type", None, None),
        ("none", "u", "n", "B", "type", None, None), ("arity", "u", "p", "run", "callable", "A", 2), ("owners", "u", "p", "run", "callable", None, 1),
        ("qualified owner", "u", "p", "run", "callable", "z.C", 1), ("constructor", "u", "p", "A", "constructor", None, 0), ("both", "z", "p", "A", "type", None, None), ("again", "z", "p", "A", "type", None, None),
    ]
    references = spark.createDataFrame(asks, "ref string, path string, package string, name string, wants string, owner_name string, arity int")
    got = {r["ref"]: (r["candidates"], r["rank"], r["target"]) for r in Y.resolve(references, known, imports).collect()}
    assert got == {
        "import": (["3"], "import", "3"), "wildcard": (["2"], "wildcard", "2"), "package": (["1"], "package", "1"), "alias": (["3"], "alias", "3"),
        "ambiguous": (["1", "2"], "package", None), "exact": (["2"], "exact", "2"), "none": ([], None, None), "arity": (["5"], "package", "5"),
        "owners": (["4", "6"], "package", None), "qualified owner": (["6"], "package", "6"), "constructor": (["7"], "package", "7"),
        "both": (["1", "2"], "import", None), "again": (["1", "2"], "import", None),
    }


def test_files_that_see_the_same_are_answered_once(spark):
    known = spark.range(30).selectExpr("concat('s', id) id", "'class' kind", "'A' name", "'p.A' qualified_name", "'p' package", "cast(null as string) owner_name", "cast(null as int) arity")
    references = spark.range(40).selectExpr("id ref", "concat('f', id) path", "'p' package", "'A' name", "'type' wants", "cast(null as string) owner_name", "cast(null as int) arity")
    imports = spark.range(40).selectExpr("concat('f', id) path", "concat('elsewhere', id) qualified_name", "true wildcard", "cast(null as string) alias")
    rows, most = most_rows(Y.resolve(references, known, imports))
    want = sorted(f"s{i}" for i in range(30))
    assert len(rows) == 40 and all(r["candidates"] == want and r["rank"] == "package" and r["target"] is None for r in rows)
    assert most < 200  # not 40 files times 30 symbols


def test_from_sources(spark):
    artifacts = files(
        spark,
        ("a/A.java", "java", "package a;\n\nimport b.Helper;\nimport c.*;\n\npublic class A extends Base {\n  void go() {\n    new Helper(1, 2);\n    Helper.help(x);\n    own();\n    nowhere();\n  }\n  void own() { }\n}\n"),
        ("b/Helper.java", "java", "package b;\n\npublic class Helper {\n  public Helper(int a, int b) { }\n  static int help(int x) { return x; }\n  static int help(int x, int y) { return y; }\n}\n"),
        ("c/Base.java", "java", "package c;\npublic class Base { }\n"),
        ("k/Use.kt", "kotlin", "package k\n\nimport b.Helper as H\n\nclass Use {\n    fun go() {\n        H.help(1)\n        H(1, 2)\n    }\n}\n"),
    )
    _, declared = S.read(artifacts)
    references = Y.references(artifacts, declared)
    resolved = Y.resolve(references, Y.symbols(declared), Y.imports(artifacts))
    edges, told = Y.linked(references, resolved, declared)
    short = lambda x: x.split("#")[-1] + "@" + x.split("#")[0]
    got = {(r["kind"], short(r["source"]), short(r["target"]), r["rank"]) for r in edges.collect()}
    assert {("EXTENDS", "A@a/A.java", "Base@c/Base.java", "wildcard"), ("CALLS", "go@a/A.java", "own@a/A.java", "package")} <= got
    assert any(x[0] == "CALLS" and x[1] == "go@k/Use.kt" and x[3] == "alias" for x in got)
    codes = {(r["path"], r["line"], r["code"]) for r in told.collect()}
    assert ("a/A.java", 11, "JAVA_UNRESOLVED_REFERENCE") in codes


SPRING = '''package web;

@RestController
@RequestMapping("/users")
@PreAuthorize("hasRole('USER')")
public class Users {
  @GetMapping("/{id}")
  public User find(@PathVariable String id) {
    return service.find(id);
  }

  @Secured("ADMIN")
  @RequestMapping(value = "/bulk", method = {RequestMethod.POST, RequestMethod.PUT})
  public List<User> bulk(@RequestBody List<User> users) { return users; }

  @DeleteMapping(PATH)
  public void remove() { }
}
'''
NEST = '''@Controller("cats")
@UseGuards(AuthGuard, RoleGuard)
export class Cats {
  @Get(":id")
  @UsePipes(ParsePipe)
  async find(@Param("id") id: string): Promise<Cat> {
    return this.cats.find(id);
  }

  @Post()
  create(@Body() cat: CreateCat): Cat {
    return cat;
  }
}

@Controller("dogs")
export class Dogs {
  @Get()
  all(): Dog[] {
    return [];
  }
}
'''
EXPRESS = '''const users = express.Router();
const dogs = Router();
app.use("/users", users);
app.use("/dogs", dogs);
function list(req, res) {
  res.json([]);
}
const auth = (req, res, next) => { next(); };
const create = async (req, res) => {
  res.end();
};
users.get("/:id", auth, list);
dogs.post("/", create);
app.delete(path, list);
app.get("/lost", gone);
other.get("/x", list);
'''
VERTX = '''package v;
class Web {
  void routes(Router router) {
    router.get("/a/:id").handler(this::check).handler(this::show);
    router.route("/b").method(HttpMethod.PUT).handler(Web::show);
  }
  void check(RoutingContext c) { }
  void show(RoutingContext c) { }
}
'''
KTOR = '''package k

fun Application.module() {
    install(CallLogging)
    routing {
        route("/api") {
            authenticate("jwt") {
                get("/me") {
                    call.respond(1)
                }
            }
            post("/items") {
                call.respond(2)
            }
        }
        get("/health") { call.respond(3) }
    }
}
'''


def test_frameworks(spark):
    artifacts = files(spark, ("S.java", "java", SPRING), ("n.ts", "typescript", NEST), ("e.ts", "typescript", EXPRESS), ("V.java", "java", VERTX), ("k.kt", "kotlin", KTOR), ("none.java", "java", None))
    statements, declared = S.read(artifacts)
    endpoints, edges, told = E.enrich(E.candidates(statements, declared), declared)
    names = {r["id"]: r["name"] for r in declared.collect()}
    rows = endpoints.collect()
    got = {(r["framework"], r["method"], r["route"], names[r["handler"]]) for r in rows}
    assert got == {
        ("spring", "GET", "/users/{id}", "find"), ("spring", "POST", "/users/bulk", "bulk"), ("spring", "PUT", "/users/bulk", "bulk"),
        ("nest", "GET", "/cats/{id}", "find"), ("nest", "POST", "/cats", "create"), ("nest", "GET", "/dogs", "all"),
        ("express", "GET", "/users/{id}", "list"), ("express", "POST", "/dogs", "create"),
        ("vertx", "GET", "/a/{id}", "show"), ("vertx", "PUT", "/b", "show"),
        ("ktor", "GET", "/api/me", "module"), ("ktor", "POST", "/api/items", "module"), ("ktor", "GET", "/health", "module"),
    }
    types = {(r["route"], r["method"]): (r["request_type"], r["response_type"]) for r in rows}
    assert types["/users/bulk", "POST"] == ("List<User>", "List<User>") and types["/cats/{id}", "GET"] == (None, "Cat") and types["/cats", "POST"] == ("CreateCat", "Cat")
    route = {r["id"]: f"{r['method']} {r['route']}" for r in rows}
    all_edges = edges.collect()
    assert {(names[r["source"]], route[r["target"]]) for r in all_edges if r["kind"] == "HANDLES"} == {(h, f"{m} {p}") for _, m, p, h in got}
    uses = {(route[r["source"]], r["ordinal"], r["target"].split(":", 1)[1]) for r in all_edges if r["kind"] == "USES_MIDDLEWARE"}
    assert uses == {
        ("GET /users/{id}", 0, "PreAuthorize"), ("POST /users/bulk", 0, "PreAuthorize"), ("POST /users/bulk", 1, "Secured"), ("PUT /users/bulk", 0, "PreAuthorize"), ("PUT /users/bulk", 1, "Secured"),
        ("GET /cats/{id}", 0, "AuthGuard"), ("GET /cats/{id}", 1, "RoleGuard"), ("GET /cats/{id}", 2, "ParsePipe"), ("POST /cats", 0, "AuthGuard"), ("POST /cats", 1, "RoleGuard"),
        ("GET /users/{id}", 0, "auth"), ("GET /a/{id}", 0, "check"),
        ("GET /api/me", 0, "plugin:CallLogging"), ("GET /api/me", 1, "authenticate:jwt"), ("POST /api/items", 0, "plugin:CallLogging"), ("GET /health", 0, "plugin:CallLogging"),
    }
    assert {(r["path"], r["code"]) for r in told.collect()} == {("S.java", "SPRING_DYNAMIC_ROUTE"), ("e.ts", "EXPRESS_DYNAMIC_ROUTE"), ("e.ts", "EXPRESS_FRAMEWORK_UNRESOLVED_HANDLER")}
