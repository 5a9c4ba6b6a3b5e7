"""Source trees, reports and stores on small inputs."""

import pytest

from strandline.functions.source import loop_metrics, masked
from strandline.operators import impact, quality, resolve
from strandline.plans.binder import query_graph
from strandline.sources import extract, extract_web, reports, store, tree

FILES = {
    "ui/Card.vue": "<template>\n  <div class=\"box other\"><slot/></div>\n</template>\n<script setup>\nconst props = defineProps({ title: String, size: Number })\nconst emit = defineEmits(['close'])\n</script>\n<style scoped>\n.box { color: red }\n</style>\n",
    "ui/Page.vue": "<template>\n  <Card :title=\"t\" @close=\"done\" />\n  <user-list v-model=\"x\" />\n</template>\n<script>\nimport Card from './Card.vue'\nimport { load as fetchIt } from '../web/client'\nexport default { mounted() { fetchIt(1); queue(fetchIt); import('./lazy.js') } }\nconst q = 'ex:Name', z = \"http://x/Person\", d = namedNode(base + id)\n</script>\n",
    "src/service.py": 'import os\n\nclass Service:\n    """Runs it."""\n    def run(self, xs):\n        for x in xs:\n            while x:\n                helper(x)\n        return self.stop()\n\n    def stop(self):\n        return missing()\n\ndef helper(x):\n    return 1 if x else 2\n\ndef lonely():\n    return "helper()"  # helper()\n',
    "web/routes.js": "// serves\nconst express = require('express');\nexport function list(req, res) { return find(req); }\nfunction find(r) {\n  if (r && r.id) { return r; }\n}\nrouter.get('/users/:id', list);\nbus.emit('user:seen', 1);\n",
    "web/client.ts": "import { list } from './routes';\nexport async function load(id: string) {\n  bus.on('user:seen', x);\n  return axios.get(`/users/${id}`);\n}\n",
    "go/main.go": "package main\n\n// Run starts.\nfunc Run() {\n\tfor i := 0; i < 3; i++ {\n\t\tstep(i)\n\t}\n}\n\nfunc step(i int) {}\n",
    "infra/Dockerfile": "FROM golang:1 AS build\nRUN make\nFROM build AS test\nFROM scratch\nCOPY --from=build /x /x\nEXPOSE 80 443\nCMD [\"/x\"]\n",
    "infra/k8s.yaml": "kind: Deployment\nmetadata: {name: web}\nspec:\n  template:\n    metadata: {labels: {app: web, tier: a}}\n    spec:\n      serviceAccountName: bot\n      containers:\n      - name: c\n        image: web:1\n        envFrom: [{configMapRef: {name: conf}}]\n---\nkind: Service\nmetadata: {name: web}\nspec: {selector: {app: web}}\n---\nkind: Service\nmetadata: {name: other}\nspec: {selector: {app: nothing}}\n",
    "tf/main.tf": 'variable "size" {}\nresource "aws_instance" "web" {\n  count = var.size # var.ignored\n  ami = data.aws_ami.base.id\n}\ndata "aws_ami" "base" {}\n',
    "voc/v.ttl": "@prefix ex: <http://x/> .\n@prefix sh: <http://www.w3.org/ns/shacl#> .\nex:Name a ex:Property .\nex:Shape a sh:NodeShape ;\n  sh:targetClass ex:Person ;\n  sh:property [ sh:path ex:Name ] .\n",
    "api/Owners.java": '@RestController\n@RequestMapping("/owners")\npublic class Owners {\n  @GetMapping("/{id}")\n  @Transactional\n  public Owner one(int id) {\n    return find(id);\n  }\n\n  @RequestMapping(value = "/", method = RequestMethod.POST)\n  public Owner add(Owner o) {\n    return o;\n  }\n\n  @DeleteMapping\n  public void drop() {\n  }\n}\n',
    "api/PetsController.cs": '[ApiController, Route("api/[controller]")]\npublic class PetsController {\n  [HttpGet("{id}")]\n  public Pet Get(int id) {\n    return null;\n  }\n\n  [HttpPost]\n  public Pet Add(Pet p) {\n    return p;\n  }\n}\n',
    "web/bus.js": "// bus.emit('not')\nexport function say(name) {\n  bus.emit(\n    'said', 1);\n  bus.once(topics.all, say);\n  bus.off(makeName());\n  bus.emit('');\n}\n",
    ".gitignore": "# made\n*.log.js\n!kept.log.js\n/out/\nlib/*.gen.go\n", ".strandlineignore": "secret.py\n", "out/x.py": "x = 1\n", "web/kept.log.js": "let y\n", "lib/a.gen.go": "package a\n", "src/secret.py": "x = 1\n",
    "node_modules/x/index.js": "function no() {}\n", "web/app.min.js": "x" * 10, "tool": "#!/usr/bin/env bash\ngo() {\n  echo\n}\n", "broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return tree.read_tree(spark, str(root), ("*.min.js",)).cache()


def test_tree(files):
    found = {r.path: (r.language, r.line_count) for r in files.collect()}
    assert set(found) == set(FILES) - {"node_modules/x/index.js", "web/app.min.js", ".gitignore", ".strandlineignore", "out/x.py", "web/kept.log.js", "lib/a.gen.go", "src/secret.py"}
    assert found["ui/Card.vue"][0] == "vue" and found["tool"] == ("bash", 4) and found["infra/Dockerfile"][0] == "dockerfile" and found["web/client.ts"] == ("typescript", 5)
    assert tree.lines(files).filter("file = 'tool'").count() == 5


def test_symbols_and_edges(spark, files):
    symbols = extract.symbols(files).cache()
    relations = extract.relations(files).cache()
    by = {(r.file, r.name): r for r in symbols.collect()}
    run = by["src/service.py", "run"]
    assert (run.kind, run.start_line, run.end_line, run.loop_depth, run.complexity) == ("method", 5, 9, 2, 3)
    assert by["src/service.py", "Service"].docstring == "Runs it." and run.parent_id == by["src/service.py", "Service"].id
    assert by["go/main.go", "Run"].exported and by["go/main.go", "Run"].docstring == "Run starts." and by["go/main.go", "Run"].loop_depth == 1
    edges = resolve.build_edges(relations, symbols).cache()
    got = {(r.type, r.src.split("#")[-1], r.dst, r.confidence) for r in edges.collect()}
    assert ("calls", "run", "src/service.py#helper", "exact") in got
    assert ("calls", "run", by["src/service.py", "stop"].id, "exact") in got
    assert ("calls", "stop", "unresolved:missing", "unresolved") in got
    assert ("calls", "list", "web/routes.js#find", "exact") in got and ("calls", "Run", "go/main.go#step", "exact") in got
    assert ("emits-event", "file:web/routes.js", "event:user:seen", "exact") in got and ("listens-event", "load", "event:user:seen", "exact") in got
    assert ("calls-http-route", "file:web/client.ts", "web/routes.js#http-route:GET /users/:id", "exact") in got
    bus = {(r.type, r.dst, r.confidence, r.line) for r in edges.filter("src = 'web/bus.js#say' and type like '%event'").collect()}
    assert bus == {("emits-event", "event:said", "exact", 3), ("listens-event", "event:topics.all", "scoped", 5), ("removes-event", "event:makeName", "scoped", 6), ("emits-event", "event:", "unresolved", 7)}
    routes = {(r.src.split(":", 1)[1], r.dst) for r in edges.filter("type = 'handles-route' and file like 'api/%'").collect()}
    owners = {("GET /owners/{id}", "one"), ("POST /owners/", "add"), ("DELETE /owners", "drop")}
    pets = {("GET /api/Pets/{id}", "Get"), ("POST /api/Pets", "Add")}
    assert routes == {(route, by["api/Owners.java", name].id) for route, name in owners} | {(route, by["api/PetsController.cs", name].id) for route, name in pets}
    assert ("selects-workload", "k8s:default/Service/web", "k8s:default/Deployment/web", "exact") in got and not any(s == "k8s:default/Service/other" for _, s, _, _ in got)
    assert ("uses-configmap", "k8s:default/Deployment/web", "k8s:default/ConfigMap/conf", "exact") in got and ("uses-image", "k8s:default/Deployment/web/c", "image:web:1", "exact") in got
    assert ("depends-on", "tf:tf/aws_instance.web", "tf:tf/var.size", "exact") in got and ("depends-on", "tf:tf/aws_instance.web", "tf:tf/data.aws_ami.base", "exact") in got
    assert not any("ignored" in d for _, _, d, _ in got)
    assert ("sh:path", "iri:http://x/Shape", "iri:http://x/Name", "exact") in got and ("sh:targetClass", "iri:http://x/Shape", "iri:http://x/Person", "exact") in got
    assert {("copies-from-stage", "docker-stage:stage2"), ("builds-from-stage", "docker-stage:test"), ("exposes-port", "docker-stage:stage2")} <= {(t, s) for t, s, _, _ in got}

    page = "ui/Page.vue#component:Page"
    assert {("renders-component", page, "ui/Card.vue#component:Card"), ("passes-prop", page, "ui/Card.vue#vue-prop:title"), ("listens-event", page, "ui/Card.vue#vue-emit:close")} <= {(r.type, r.src, r.dst) for r in edges.collect()}
    card = {(r.type, r.dst, r.confidence) for r in edges.filter("file = 'ui/Card.vue'").collect()}
    assert {("uses-css-class", "ui/Card.vue#css-class:box", "exact"), ("uses-css-class", "unresolved:class:other", "unresolved")} <= card
    loose = {(r.type, r.dst, r.confidence) for r in edges.filter("file = 'ui/Page.vue'").collect()}
    assert {("calls", "web/client.ts#load", "exact"), ("references-symbol", "web/client.ts#load", "exact"), ("imports", "module:./lazy.js", "exact"), ("references-term", "iri:http://x/Person", "exact"), ("references-term", "term:ex:Name", "weak")} <= loose
    assert relations.filter("type = 'dynamic-iri'").count() == 1

    dead = {r.name for r in quality.dead_code(symbols.filter("language = 'python'"), edges, ("function", "method"), include_exported=True).collect()}
    assert dead == {"run", "lonely"}
    met = query_graph("MATCH (a:method)-[:calls]->(b) WHERE a.file CONTAINS 'service' RETURN a.name, b.name ORDER BY b.name", symbols.withColumn("transitive_loop_depth", symbols["loop_depth"]), edges)
    assert [tuple(r) for r in met.collect()] == [("run", "helper"), ("run", "stop")]
    assert {r.node for r in impact.impact(symbols, edges, spark.createDataFrame([("src/service.py#helper",)], "node string")).collect()} == {run.id}


def test_signatures_literals_and_imports():
    assert extract_web.return_types("func f(a int) (string, error)", "go") == ["string", "error"] and extract_web.return_types("def f(x) -> list[int]:", "python") == ["list[int]"]
    assert extract_web.return_types("public static Foo bar(int x)", "java") == ["Foo"] and extract_web.return_types("void x()", "java") == [] and extract_web.return_types("f(x): Promise<A> {", "typescript") == ["Promise<A>"]
    assert extract_web.turtle_literals('ex:a rdfs:label "Hi \\"x\\""@en ;\n  ex:b "y" .') == [(1, "rdfs:label", 'Hi \\"x\\"', "en"), (2, "ex:b", "y", "")]
    assert extract_web.imported_names("import A, { b as c, type D } from './m'\nimport * as n from 'k'") == {"A": ("./m", "default"), "c": ("./m", "b"), "D": ("./m", "D"), "n": ("k", "*")}


def test_masking_and_loops():
    assert masked("a = 'x' # y\n", "python") == "a =        \n" and masked('f("{") // }\n', "go") == "f(   )     \n"
    body = ["function f(xs) {", "  for (const x of xs) {", "    xs.find(x); new Foo(); f(x);", "  }", "  xs.find(1)", "}"]
    assert loop_metrics(body, "f", "javascript") == {"loop_depth": 1, "linear_scan_in_loop": 1, "alloc_in_loop": 1, "recursion_in_loop": True}
    assert loop_metrics(["def f(x)", "  while x do", "    x.each do |y|", "    end", "  end", "end"], "f", "ruby")["loop_depth"] == 2


def test_reports(spark, tmp_path):
    (tmp_path / "a.lcov").write_text("TN:\nSF:/ci/repo/src/a.py\nDA:1,5\nDA:2,0\nDA:1,2\nend_of_record\nSF:src/b.py\nDA:3,1\nend_of_record\nSF:zzz.py\nDA:1,1\n")
    found = reports.read_lcov(spark, str(tmp_path / "a.lcov"))
    assert {tuple(r) for r in found.collect()} == {("/ci/repo/src/a.py", 1, 7), ("/ci/repo/src/a.py", 2, 0), ("src/b.py", 3, 1), ("zzz.py", 1, 1)}
    paths = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("lib/a.py",)], "path string")
    assert {tuple(r) for r in reports.known_files(found, paths).collect()} == {("src/a.py", 1, 7), ("src/a.py", 2, 0), ("src/b.py", 3, 1)}
    (tmp_path / "d.diff").write_text("--- a/x.go\n+++ b/x.go\n@@ -1,2 +1,3 @@ f\n+a\n@@ -9 +10,0 @@\n-b\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n--- a/z\n+++ b/z\n@@ -5 +7 @@\n")
    assert {tuple(r) for r in reports.read_diff(spark, str(tmp_path / "d.diff")).collect()} == {("x.go", 1, 3), ("x.go", 10, 10), ("z", 7, 7)}
    (tmp_path / "log").write_text("commit:ab1\nx\ny\n\ncommit:cd2\nx\n")
    assert {tuple(r) for r in reports.read_history(spark, str(tmp_path / "log")).collect()} == {("ab1", "x"), ("ab1", "y"), ("cd2", "x")}
    assert reports.read_history(spark, str(tmp_path / "log"), 1).count() == 2


def test_store(spark, tmp_path, files):
    store.write_graph({"files": files, "lines": tree.lines(files)}, str(tmp_path), 1)
    store.write_graph({"files": files.limit(1)}, str(tmp_path), 2)
    assert set(store.read_graph(spark, str(tmp_path))) == {"files"} and store.read_graph(spark, str(tmp_path), 1)["files"].count() == files.count()
    with pytest.raises(ValueError):
        store.read_graph(spark, str(tmp_path), 9)
    changed = files.selectExpr("path", "case when path = 'tool' then 'x' else sha256 end as sha256").filter("path <> 'go/main.go'")
    assert {tuple(r) for r in tree.stale(files, changed).collect()} == {("tool", "changed"), ("go/main.go", "deleted")}
    assert store.valid_vectors(files.selectExpr("path as file", "sha256"), files) and not store.valid_vectors(changed.selectExpr("path as file", "sha256"), files)
