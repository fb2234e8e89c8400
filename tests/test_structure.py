"""Comments, strings, blocks and scopes of source text, by cases that are easily got wrong."""

import re

import pytest
from pyspark.sql import functions as F

from factloom import structure
from factloom.operators import extract as X
from factloom.operators.classify import classify
from factloom.operators.lexing import SYNTAX, Lines, Masks, block_tree, blocks, lexical_masks
from factloom.plans.project import project_facts


def masked(text, language):
    return [text[s:e] for _, s, e in Masks(text, language).all]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("javascript", "a = 'it\\'s // x'; // b's\nc = \"/*\"; /* d */ e", ["'it\\'s // x'", "// b's", '"/*"', "/* d */"]),
        ("javascript", "`a ${b ? `c ${'}'}` : {}} d` + e", ["`a ", "`c ", "'}'", "}`", "} d`"]),
        ("javascript", "x = a / b / c; y = /['\"]/g; return /`/", ["/['\"]/g", "/`/"]),
        ("javascript", "open = 'never closed\nnext()", ["'never closed"]),
        ("typescript", "/* never closed\nclass A {}", ["/* never closed\nclass A {}"]),
        ("python", 'x = rb"a\\"b" # c "d"\ny = """e\n\'\'\'f""" + \'\'', ['rb"a\\"b"'[2:], '# c "d"', '"""e\n\'\'\'f"""', "''"]),
        ("rust", "fn f<'a>(x: &'a str) { '\"'; r##\"a\"# b\"##; /* /* */ c */ }", ["'\"'", 'r##"a"# b"##', "/* /* */ c */"]),
        ("go", "`a\n\"b` + \"c\\\"\" + '\"'", ["`a\n\"b`", '"c\\""', "'\"'"]),
        ("csharp", '@"a""b\\" + "c"', ['@"a""b\\"', '"c"']),
        ("ruby", "x = <<~A\n  'b\nA\ny = \"c # d\" # e\n=begin\nf\n=end\ng / h", ["\n  'b\nA", '"c # d"', "# e", "=begin\nf\n=end"]),
        ("php", "it's <?php # a 'b\n#[Route('/c')]\n$x = <<<E\n\"d\nE;\n?> isn't", ["# a 'b", "'/c'", "\n\"d\nE"]),
        ("vue", "<p>it's `here`</p><script>// a\nb('c')</script> don't", ["// a", "'c'"]),
        ("sql", "select 'it''s -- x' -- y\n/* z */", ["'it''s -- x'", "-- y", "/* z */"]),
        ("elixir", '@doc """\nget "/x"\n"""\nf("a")', ['"""\nget "/x"\n"""', '"a"']),
        ("kotlin", '/* a /* b */ c */ val s = """d "e" """', ["/* a /* b */ c */", '"""d "e" """']),
        ("clojure", '; a "b\n(f "c;d")', ['; a "b', '"c;d"']),
        ("unknown", "// a", []),
        ("python", "", []),
    ],
)
def test_masks(language, text, want):
    assert masked(text, language) == want


MARKS = "'\"`/*#\n{}<!--$\\"


def test_masks_are_apart_and_in_order():
    text = "".join(chr(97 + k % 5) + MARKS[k * 7 % len(MARKS)] for k in range(4000))
    for language in SYNTAX:
        end = 0
        for _, s, e in Masks(text, language).all:
            assert end <= s <= e <= len(text)
            end = e
        for b in blocks(text, language):
            assert b.start < b.body <= max(b.end, b.body) and b.parent < len(text)


def spans(text, language, openers="{do:"):
    return [re.sub(r"\s+", " ", text[b.start : b.end]) for b in blocks(text, language) if b.opener in ("{", "do", ":") and b.opener in openers]


def test_blocks():
    assert spans("f(a => { '}'; if (b) { c } }) }", "javascript") == ["{ '}'; if (b) { c } ", "{ c "]
    ruby = "class A\n  def end?\n    return 1 if b\n    x = if c then d else e end\n    while f do\n      g.each do |h| end\n    end\n    i.class\n  end\nend\nj"
    assert spans(ruby, "ruby") == ["class A def end? return 1 if b x = if c then d else e end while f do g.each do |h| end end i.class end ", "def end? return 1 if b x = if c then d else e end while f do g.each do |h| end end i.class ", "if c then d else e ", "while f do g.each do |h| end ", "do |h| "]
    python = "class A:\n    def f(self,\n  x):\n        if x: return {\n'a': 1}\n        for y in x:  # z:\n\n            y\n# out\n    b = 1\nc"
    assert spans(python, "python") == ["class A: def f(self, x): if x: return { 'a': 1} for y in x: # z: y # out b = 1 ", "def f(self, x): if x: return { 'a': 1} for y in x: # z: y # out ", "for y in x: # z: y # out "]
    assert spans("scope \"/a\" do\n  f fn x -> x end\n  g(do: 1)\nend", "elixir") == ["do f fn x -> x end g(do: 1) ", "fn x -> x "] or spans("scope do\n f fn x -> x end\nend", "elixir")


def test_lines():
    assert [Lines("a\nb\n\nc").of(k) for k in (0, 1, 2, 4, 5)] == [1, 1, 2, 3, 4]


FILES = {
    "a.py": '"""\nclass Gone: pass\n"""\nclass Kept(BaseModel):\n    name: str\n# import no\nimport yes\n',
    "b.ts": "// app.get('/no', x)\napp.get('/yes', `handler`, h)\n/* axios.get('/no') */ axios.get('/call')\nconst q = \"fetch('/no')\"\n",
    "c.php": "<?php\n/**\n * @ORM\\Entity\n */\nclass User {}\n// class No {}\n",
    "d/routes.rb": "namespace :a do\n  get 'x', to: 'y#z'\n  scope 'never-closed' do\n    get 'in', to: 'y#in'\n",
    "e.java": '@RequestMapping("/v1")\nclass A {\n  class Inner {\n    @GetMapping("/in")\n    int in() { return 1; }\n  }\n}\nclass B {\n  @GetMapping("/out")\n  int out() { return 1; }\n}\n',
    "f.ts": "@Controller('cats')\nexport class Cats {\n  @Get()\n  all() {}\n}\n@Controller({ path: 'dogs', host: 'x' })\nexport class Dogs {\n  @Get(':id')\n  one() {}\n}\n",
    "g.php": "<?php\n$app->group('/api', function ($group) {\n  $group->get('/a', 'A:a');\n});\n$app->get('/b', 'B:b');\n",
    "h.rs": 'fn x() { web::scope("/x").route("/y", web::get().to(y)) } fn z() { app.route("/z", web::get().to(z)) }\n',
    "i.rb": "resources :boxes do\n  resources :lines, path: 'racks' do\n    get 'dust', to: 'lines#dust'\n  end\nend\n",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [*FILES.items(), ("null.py", None)]
    return classify(spark.createDataFrame(rows, "path string, content string"))


def test_facts_outside_comments_and_strings(files):
    got = {(r.path, r.family, r.subject) for r in X.extract(files, ["symbol", "import", "call", "route", "data-model"]).collect() if r.path in ("a.py", "b.ts", "c.php")}
    assert got == {("a.py", "symbol", "Kept"), ("a.py", "data-model", "Kept"), ("a.py", "import", "yes"), ("b.ts", "route", "/yes"), ("b.ts", "call", "/call"), ("c.php", "symbol", "User"), ("c.php", "data-model", None)} or ("c.php", "data-model", "User") in got


def test_routes_in_scopes(files):
    got = {(r.framework, r.path) for r in X.api_routes(files).collect()}
    assert {("rails", "/a/x"), ("rails", "/a/never-closed/in"), ("spring", "/v1/in"), ("spring", "/out"), ("nestjs", "/cats"), ("nestjs", "/dogs/:id"), ("slim", "/api/a"), ("slim", "/b"), ("actix", "/x/y"), ("actix", "/z"), ("rails", "/boxes/:box_id/racks/:line_id/dust"), ("rails", "/boxes/:box_id/racks/:id")} <= got
    assert not {p for _, p in got if "no" in p.split("/")}


def test_tables(files):
    assert {r.path for r in lexical_masks(files).collect()} >= {"a.py", "b.ts", "c.php"}
    tree = block_tree(files).filter("path = 'e.java' and opener = '{'").orderBy("block").collect()
    assert [(r.line_start, r.line_end, r.parent is None) for r in tree] == [(2, 7, True), (3, 6, False), (5, 5, False), (8, 11, True), (10, 10, False)]
    assert block_tree(files.filter("path = 'empty.py'")).count() == 0


def test_implied_routes(spark):
    text = "resources :a, 'b', only: %w[index destroy]\nresources :c, except: [:index, :create, :update], path: '/cs/', param: :key do\n  resources :d, shallow: true, only: :show\nend\nresource :e, only: [:show, :unknown]\nresources 'no' => 'x'\n# resources :gone\n"
    files = classify(spark.createDataFrame([("config/routes.rb", text), ("x/r.php", "<?php Route::resource('a-bs.classes', C::class, ['only' => ['edit']]);"), ("r.ex", 'resources "/u", U, only: [:delete]\n')], "path string, content string"))
    got = {(r.method, r.path, r.handler) for r in X.api_routes(files).collect()}
    assert got == {
        ("GET", "/a", "a#index"), ("DELETE", "/a/:id", "a#destroy"), ("GET", "/b", "b#index"), ("DELETE", "/b/:id", "b#destroy"), ("GET", "/cs/:key", "c#show"), ("DELETE", "/cs/:key", "c#destroy"), ("GET", "/d/:id", "d#show"), ("GET", "/e", "e#show"),
        ("GET", "/a-bs/{a_b}/classes/{class}/edit", "C@edit"), ("DELETE", "/u/:id", "U, :delete"),
    }


def test_rows_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    """A corpus written from one small file is scanned by as many tasks as a shuffle has, each with its share."""
    spark.range(400).select(F.col("id").alias("vec_id")).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    files = structure.corpus(spark, str(tmp_path), [(0, "a{k}.js", "x();")])
    shares = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 4 and max(shares) <= 2 * 400 / len(shares)


def test_project_reads_its_files_once(spark):
    """The corpus is read and classified once, however many facts derive from it."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    files = spark.createDataFrame([("a.js", "app.get('/x', y);\n"), ("b.py", "class A(BaseModel):\n    n: int\n")], "path string, content string")
    facts = project_facts(classify(files.withColumn("content", counted.asNondeterministic()("content"))))
    assert facts["routes"].count() == 1 and facts["models"].count() == 1
    assert read.value == 2
