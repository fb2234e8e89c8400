"""Nested and lazy frontend routes."""

import pytest

from factloom.operators import extract as X
from factloom.operators.classify import classify
from factloom.operators.frontend_routes import frontend_routes, joined, route_nodes


@pytest.mark.parametrize(("parent", "own", "want"), [("", "", "/"), ("", "a", "/a"), ("/a", "", "/a"), ("/a", ":id/", "/a/:id"), ("/a", "/b", "/b"), ("/a", "/", "/a"), ("/a", "b/*", "/a/b"), ("/", "*", "/")])
def test_joined(parent, own, want):
    assert joined(parent, own) == want


def test_elements():
    text = "<Routes>\n  {/* <Route path=\"/no\" /> */}\n  <Route path=\"/\" element={<A b={1 > 0} c='>' />}>\n    <Route index element={<B />} /><Route path={'c'} component={C}>\n      <Route path=':d' element={<D/>} />\n    </Route>\n  </Route>\n  <Route path=\"e/*\" element={<E />} />\n  <Route element={<F />}><Route path=\"g\" element={<G />} /></Route>\n</Routes>"
    assert [(r, c, uses, leaf, line) for _, r, c, _, uses, leaf, line in route_nodes(text, "typescript")] == [("/", "A", None, False, 3), ("/", "B", None, True, 4), ("/c", "C", None, False, 4), ("/c/:d", "D", None, True, 5), ("/e", "E", "E", True, 8), ("/g", "G", None, True, 9)]


def test_objects():
    text = "const r = [{ path: 'a', component: A, meta: { path: 'no' }, children: [{ path: 'b', children: [{ path: 'c', component: () => import('./c') }] }, ...more] }, { path: 'd', children: rest }];\nconst x = { path: '/tmp' }; // { path: 'no', component: N }\nconst s = \"{ path: 'no', component: N }\";\n"
    assert [(r, c, m, uses) for _, r, c, m, uses, _, _ in route_nodes(text, "typescript")] == [("/a", "A", None, None), ("/a/b", None, None, None), ("/a/b/c", None, "./c", None), ("/d", None, None, "rest")]
    assert route_nodes("", "typescript") == [] and route_nodes("{ path: 'a', component: A", "vue") == []


FILES = {
    "a/app.tsx": "import Two from './two';\n<Routes><Route path=\"/one/*\" element={<Two />} /><Route path=\"/other/*\" element={<Two />} /></Routes>;\n",
    "a/two.tsx": "export default () => <Routes><Route path=\"x\" element={<X />} /></Routes>;\n",
    "b/ring.ts": "import { back } from './ring2';\nexport const there = [{ path: 'p', component: P, children: back }];\n",
    "b/ring2.ts": "import { there } from './ring';\nexport const back = [{ path: 'q', component: Q, children: there }];\n",
    "c/app.routes.ts": "export const routes = [{ path: 'm', loadChildren: () => import('./m.module') }];\n",
    "c/m.module.ts": "import { R } from './m-routing.module';\n",
    "c/m-routing.module.ts": "const routes = [{ path: '', loadComponent: () => import('./z') }, { path: ':id', component: M }];\n",
    "c/app.test.ts": "const routes = [{ path: 'no', component: N }];\n",
    "d/null.ts": None,
    "d/empty.ts": "",
}


def test_routes_over_files(spark):
    files = classify(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    got = {(r.path, r.name) for r in frontend_routes(files, X.extract(files, ["binding", "import"])).collect()}
    assert got == {("a/app.tsx", "/one"), ("a/app.tsx", "/other"), ("a/two.tsx", "/one/x"), ("a/two.tsx", "/other/x"), ("b/ring.ts", "/p"), ("b/ring2.ts", "/q"), ("c/app.routes.ts", "/m"), ("c/m-routing.module.ts", "/m"), ("c/m-routing.module.ts", "/m/:id")}
