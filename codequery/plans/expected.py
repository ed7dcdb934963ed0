"""What the queries over fixed files must give, row by row, written down and read through; no SQL computes it.

A table is its columns with their types, and its rows.
"""

from __future__ import annotations

EXPECTED = {
    "f11_return_phrase": (
        "x VARCHAR, phrase VARCHAR",
        [
            ('', None),
            ('CompletableFuture<List<User>>', 'future List'),
            ('Deque<X>', 'collection of X'),
            ('Foo<Bar>', 'Foo'),
            ('HashMap<K,List<V>>', 'map of K to List'),
            ('List<User>', 'list of User'),
            ('Map<String,User>', 'map of String to User'),
            ('Optional<User>', 'optional User'),
            ('Set<Order>', 'set of Order'),
            ('Stream<int[]>', 'stream of int'),
            ('User', 'User'),
            ('User[]', 'array of User'),
            ('void', None),
        ],
    ),
    "f15_fqn_parts": (
        "x VARCHAR, class_fqn VARCHAR, package VARCHAR, simple_name VARCHAR, n_params INTEGER, kind VARCHAR",
        [
            ('B#x(a)', 'B', '', 'x', 1, 'method'),
            ('Top', 'Top', '', 'Top', 0, 'class'),
            ('com.a.B#<init>()', 'com.a.B', 'com.a', '<init>', 0, 'constructor'),
            ('com.a.B#run(int,Map<String,List<X>>)', 'com.a.B', 'com.a', 'run', 2, 'method'),
            ('com.a.B', 'com.a.B', 'com.a', 'B', 0, 'class'),
            ('p.q.R#m(Map<A,B>,C,D)', 'p.q.R', 'p.q', 'm', 3, 'method'),
        ],
    ),
    "f18_segmented_words": (
        "word VARCHAR, parts VARCHAR",
        [
            ('alist', 'a list'),
            ('graph', 'graph'),
            ('hashmapnode', 'hash map node'),
            ('skiplist', 'skip list'),
            ('xyz', 'xyz'),
        ],
    ),
    "f25_linked_classes": (
        "x VARCHAR, classes VARCHAR",
        [
            ('No links here. Second one', ''),
            ('One only', ''),
            ('Uses {@link a.b.Cache#get} and {@link Store}. More.\n@see x.Index#put() end', 'Cache,Store,Index'),
        ],
    ),
    "g19_package_hints": (
        "caller VARCHAR, name VARCHAR, receiver VARCHAR, arity INTEGER, package_hint VARCHAR",
        [
            ('p.Outer#open(int,String...)', 'find', 'Outer', 1, None),
            ('p.Outer#open(int,String...)', 'more', 'Outer', 2, None),
            ('p.Outer#open(int,String...)', 'put', 'Store', 3, 'a.b'),
            ('p.Outer#open(int,String...)', 'two', 'Outer', 1, None),
            ('shop.Cart#sum(Tax)', 'price', 'Item', 0, 'shop.model'),
        ],
    ),
    "p9_hints": (
        "text VARCHAR, project VARCHAR, project_explicit BOOLEAN, language VARCHAR, language_explicit BOOLEAN",
        [
            ('fast merge', 'Lucene', True, '.java', True),
            ('in:rust', None, False, '.rs', True),
            ('no: hint', None, False, None, False),
            ('python parser', None, False, '.py', False),
            ('solr cloud', 'solr', False, None, False),
        ],
    ),
    "r26_oversample": (
        "type VARCHAR, text VARCHAR, factor INTEGER",
        [
            ('HYBRID', 'HashMap merge', 1),
            ('HYBRID', 'merge lists', 3),
            ('KEYWORD', 'HashMap merge', 1),
            ('KEYWORD', 'merge lists', 1),
            ('VECTOR', 'HashMap merge', 0),
            ('VECTOR', 'merge lists', 0),
        ],
    ),
    "s10_typescript": (
        "kind VARCHAR, owner VARCHAR, name VARCHAR, params VARCHAR, annotations VARCHAR, body VARCHAR, line INTEGER",
        [
            ('class', '', 'Shown', '', 'interface', '', 14),
            ('class', '', 'View', '', 'Component', '', 4),
            ('method', 'View', 'draw', 'ctx,n', '', 'draw(ctx: Ctx, n: number): void {', 5),
            ('method', 'view', 'load', 'id', '', 'export const load = async (id: string) => {', 10),
        ],
    ),
    "s11_script_json": (
        "path VARCHAR, kind VARCHAR, owner VARCHAR, name VARCHAR, params VARCHAR, bases VARCHAR, annotations VARCHAR, calls VARCHAR, line INTEGER, package VARCHAR",
        [
            ('a/b.rb', 'class', '', 'C', '', 'D', '', '', 1, 'x.b'),
            ('a/b.rb', 'class', '', 'b', '', '', '', '', 1, 'x.b'),
            ('a/b.rb', 'method', 'C', 'go', 'n', '', 'm', 'run,stop', 2, 'x.b'),
            ('a/b.rb', 'method', 'b', 'top', '', '', '', '', 11, 'x.b'),
            ('z.rb', 'class', '', 'module', '', '', '', '', 1, ''),
            ('z.rb', 'method', 'module', 'solo', '', '', '', '', 1, ''),
        ],
    ),
    "s12_languages_by_rule": (
        "path VARCHAR, kind VARCHAR, owner VARCHAR, name VARCHAR, params VARCHAR, calls VARCHAR, line INTEGER, end_line INTEGER",
        [
            ('lib/cache.rb', 'class', '', 'Cache', '', '', 4, 4),
            ('lib/cache.rb', 'class', '', 'Store', '', '', 3, 3),
            ('lib/cache.rb', 'method', 'Cache', 'get', 'key,default', 'fetch', 5, 9),
            ('lib/cache.rb', 'method', 'Cache', 'open', 'path', '', 11, 13),
            ('lib/core.rs', 'class', '', 'Node', '', '', 3, 3),
            ('lib/core.rs', 'class', '', 'Node', '', '', 5, 5),
            ('lib/core.rs', 'method', 'Node', 'grow', 'self,by', 'step', 6, 9),
            ('lib/shape.kt', 'class', '', 'Shape', '', '', 5, 5),
            ('lib/shape.kt', 'method', 'Shape', 'area', 'scale', 'sqrt', 6, 8),
        ],
    ),
    "s17_generic_documents": (
        "path VARCHAR, stem VARCHAR, title VARCHAR, description VARCHAR",
        [
            ('conf/app.yaml', 'app', 'name x', 'name: x ports: - 1 - 2 mode: fast'),
            ('docs/guide.md', 'guide', 'Guide', 'Intro text.'),
            ('docs/notes.txt', 'notes', 'First para line one', 'First para line one line two'),
            ('docs/old.rst', 'old', 'Title', 'Title ====='),
        ],
    ),
    "s18_markdown_chunks": (
        "path VARCHAR, section BIGINT, start INTEGER, end INTEGER, text VARCHAR, breadcrumb VARCHAR",
        [
            ('docs/guide.md', 1, 1, 3, '# Guide\nIntro text.\n', 'Guide'),
            ('docs/guide.md', 2, 4, 10, '## Setup\nRun it. See [the notes](notes.md#run) and [web](https://x.y).\n\n```\n# not a heading\n```\n', 'Guide > Setup'),
            ('docs/guide.md', 3, 11, 13, '### Linux\nUse apt.\n', 'Guide > Setup > Linux'),
            ('docs/guide.md', 4, 14, 16, '## Use\nCall [home](#guide).\n', 'Guide > Use'),
        ],
    ),
    "s19_rst_chunks": (
        "path VARCHAR, section BIGINT, start INTEGER, end INTEGER, text VARCHAR, title VARCHAR",
        [
            ('docs/old.rst', 1, 1, 5, 'Title\n=====\n\nBody here.\n', 'Title'),
            ('docs/old.rst', 2, 6, 10, 'Next part\n---------\n\nMore.\n', 'Next part'),
        ],
    ),
    "s1_walk": (
        "path VARCHAR",
        [
            ('/r/app/src/main/java/shop/Cart.java',),
            ('/r/app/src/main/java/shop/Tax.java',),
            ('/r/tools/src/pkg/run.py',),
        ],
    ),
    "s21_yaml_chunks": (
        "path VARCHAR, section BIGINT, start INTEGER, end INTEGER, text VARCHAR, title VARCHAR",
        [
            ('conf/app.yaml', 1, 1, 1, 'name: x', 'name'),
            ('conf/app.yaml', 2, 2, 4, 'ports:\n  - 1\n  - 2', 'ports'),
            ('conf/app.yaml', 3, 5, 6, 'mode: fast\n', 'mode'),
        ],
    ),
    "s22_single_chunks": (
        "path VARCHAR, start INTEGER, end INTEGER, size INTEGER, title VARCHAR, description VARCHAR, name VARCHAR",
        [
            ('a/Readme.cfg', 1, 3, 139, 'Readme', 'x = 1', 'x_1'),
            ('b/empty.ini', 1, 2, 1, 'empty', 'empty', 'empty'),
            ('conf/app.yaml', 1, 6, 38, 'app', 'name: x', 'name_x'),
            ('docs/guide.md', 1, 16, 166, 'guide', 'Guide', 'Guide'),
            ('docs/notes.txt', 1, 8, 50, 'notes', 'First para line one', 'First_para_line_one'),
            ('docs/old.rst', 1, 10, 52, 'old', 'Title', 'Title'),
        ],
    ),
    "s23_links": (
        "path VARCHAR, target VARCHAR, anchor VARCHAR",
        [
            ('docs/guide.md', 'guide', 'guide'),
            ('docs/guide.md', 'notes', 'run'),
        ],
    ),
    "s24_build_files": (
        "path VARCHAR, tool VARCHAR, group_id VARCHAR, artifact_id VARCHAR, version VARCHAR, modules VARCHAR, deps VARCHAR",
        [
            ('a/package.json', 'node', 'org', 'web', '1.0', '', 'npm:react:^18:runtime,npm:y:2:runtime'),
            ('a/pom.xml', 'maven', 'org.p', 'a', '2.0', 'core', 'org.p:lib:1.5:test'),
            ('b/build.gradle', 'gradle', 'g.b', 'b', '0.1', '', 'com.google:guava:31:compile,:core:LOCAL:compile'),
            ('c/pyproject.toml', 'python', 'python', 'my_tool', '3', '', 'python:requests:2.0:runtime,python:numpy:runtime'),
            ('d/CMakeLists.txt', 'cmake', 'cmake', 'demo', '1.2', '', ''),
        ],
    ),
    "s25_gradle": (
        "path VARCHAR, group_id VARCHAR, artifact_id VARCHAR, version VARCHAR, deps VARCHAR",
        [
            ('app/build.gradle.kts', 'org.whole', 'app', '7.1', 'org.json:core:2.9,org.log:log4:1.2,net.http:client:5,:core:LOCAL'),
            ('build.gradle', 'org.whole', 'whole', '7.1', 'org.json:core:2.9,junit:junit:4.13'),
            ('core/build.gradle', 'org.core', 'core', '1.0-core', ''),
        ],
    ),
    "s27_build_precedence": (
        "path VARCHAR, tool VARCHAR, artifact_id VARCHAR",
        [
            ('a/pom.xml', 'maven', 'a'),
            ('b/build.gradle', 'gradle', 'b'),
            ('c/pyproject.toml', 'python', 'my_tool'),
            ('d/CMakeLists.txt', 'cmake', 'demo'),
        ],
    ),
    "s28_projects": (
        "of VARCHAR, project VARCHAR, doc_type VARCHAR, n BIGINT",
        [
            ('all', 'shop', 'class', 2),
            ('all', 'shop', 'method', 4),
            ('all', 'tools', 'class', 1),
            ('all', 'tools', 'method', 3),
            ('tools', 'tools', 'class', 1),
            ('tools', 'tools', 'method', 3),
        ],
    ),
    "s2_discovery": (
        "root VARCHAR",
        [
            ('/w/a',),
            ('/w/b',),
            ('/w/d/e',),
        ],
    ),
    "s30_pipelines": (
        "name VARCHAR, visible BOOLEAN, retrievers VARCHAR, merger VARCHAR, rerankers VARCHAR, oversample INTEGER, requires VARCHAR, dispatches BOOLEAN",
        [
            ('_auto', False, '', None, '', 1, '', True),
            ('both', True, 'keyword,vector', 'rrf', 'ce,mmr', 3, 'vectors,ce', False),
            ('words', True, 'keyword', None, '', 1, '', False),
        ],
    ),
    "s30_synonyms": (
        "lhs VARCHAR, rhs VARCHAR",
        [
            ('a', 'b'),
            ('auto', 'vehicle'),
            ('big', 'huge'),
            ('big', 'large'),
            ('car', 'vehicle'),
            ('huge', 'big'),
            ('huge', 'large'),
            ('large', 'big'),
            ('large', 'huge'),
        ],
    ),
    "s4_comments": (
        "fqn VARCHAR, comment VARCHAR, flags VARCHAR",
        [
            ('Box#put', 'Puts.', 'static,async'),
            ('Box#size', '', 'get'),
            ('Box', 'A box.', ''),
            ('Shape#area', 'Its area.', ''),
            ('Shape', 'A shape.', ''),
            ('Shown', '', 'interface'),
            ('p.Outer#close()', '', 'abstract'),
            ('p.Outer#open(int,String...)', 'Opens it.', 'static,synchronized'),
            ('p.Outer', 'Keeps things.\nSee {@link Store}.', 'abstract'),
            ('p.Outer.Inner#size()', 'The size.', ''),
            ('p.Outer.Inner', '', 'static'),
            ('shop.Cart', 'A cart.', ''),
            ('tools.src.pkg.A#make', 'Makes one.', 'async,static'),
            ('tools.src.pkg.A', 'An A.', ''),
            ('u.util#join', 'Joins.', ''),
        ],
    ),
    "s4_java": (
        "path VARCHAR, kind VARCHAR, owner VARCHAR, name VARCHAR, params VARCHAR, types VARCHAR, returns VARCHAR, access VARCHAR, calls VARCHAR, line INTEGER, end_line INTEGER",
        [
            ('/app/src/main/java/shop/Cart.java', 'class', '', 'Cart', '', '', 'class', 'public', '', 8, 24),
            ('/app/src/main/java/shop/Cart.java', 'field', 'Cart', 'items', '', '', 'List<Item>', 'private', '', 9, 9),
            ('/app/src/main/java/shop/Cart.java', 'field', 'Cart', 'total', '', '', 'int', 'private', '', 10, 10),
            ('/app/src/main/java/shop/Cart.java', 'method', 'Cart', '<init>', 'items', 'List<Item>', None, 'public', '', 12, 14),
            ('/app/src/main/java/shop/Cart.java', 'method', 'Cart', 'report', 'n', 'int', 'void', 'private', '', 23, 23),
            ('/app/src/main/java/shop/Cart.java', 'method', 'Cart', 'sum', 'tax', 'Tax', 'int', 'public', 'Item.price/0,Tax.of/1,Cart.report/1', 16, 21),
            ('/app/src/main/java/shop/Cart.java', 'reads', 'Cart', 'items', '', '', 'sum', '', '', 16, 16),
            ('/app/src/main/java/shop/Cart.java', 'writes', 'Cart', 'items', '', '', '<init>', '', '', 12, 12),
            ('/app/src/main/java/shop/Cart.java', 'writes', 'Cart', 'total', '', '', 'report', '', '', 23, 23),
            ('/app/src/main/java/shop/Tax.java', 'class', '', 'Tax', '', '', 'interface', 'public', '', 3, 5),
            ('/app/src/main/java/shop/Tax.java', 'method', 'Tax', 'of', 'i', 'Item', 'int', '', '', 4, 4),
        ],
    ),
    "s5_resolved_calls": (
        "caller VARCHAR, callee VARCHAR, resolved BOOLEAN",
        [
            ('shop.Cart#sum(Tax)', 'Item.price/0', False),
            ('shop.Cart#sum(Tax)', 'shop.Cart#report(int)', True),
            ('shop.Cart#sum(Tax)', 'shop.Tax#of(Item)', True),
        ],
    ),
    "s6_simple_types": (
        "x VARCHAR, simple VARCHAR",
        [
            ('a.b.C$D', 'C$D'),
            ('a.b.C...', 'C...'),
            ('int', 'int'),
            ('java.util.List<a.B>', 'List<B>'),
            ('java.util.Map<java.lang.String,x.y.Z[]>', 'Map<String,Z[]>'),
        ],
    ),
    "s7_relationships": (
        "src VARCHAR, edge_type VARCHAR, dst VARCHAR",
        [
            ('shop.Cart#<init>(List<Item>)', 'takes_type', 'java.util.List'),
            ('shop.Cart#sum(Tax)', 'takes_type', 'shop.Tax'),
            ('shop.Cart', 'annotated_by', 'Service'),
            ('shop.Cart', 'implements_iface', 'Priced'),
            ('shop.Cart', 'inherits', 'Base'),
            ('shop.Tax#of(Item)', 'takes_type', 'Item'),
            ('tools.src.pkg.Runner', 'inherits', 'Base'),
        ],
    ),
    "s8_field_access": (
        "owner VARCHAR, field VARCHAR, kind VARCHAR, method VARCHAR",
        [
            ('Cart', 'items', 'reads', 'sum'),
            ('Cart', 'items', 'writes', '<init>'),
            ('Cart', 'total', 'writes', 'report'),
        ],
    ),
    "s9_python": (
        "kind VARCHAR, owner VARCHAR, name VARCHAR, bases VARCHAR, annotations VARCHAR, calls VARCHAR, package VARCHAR, line INTEGER",
        [
            ('class', '', 'Runner', 'Base', '', '', 'tools.src.pkg', 5),
            ('field', 'Runner', 'n', '', '', '', 'tools.src.pkg', 5),
            ('field', 'Runner', 'name', '', '', '', 'tools.src.pkg', 5),
            ('method', 'Runner', '__init__', '', '', '', 'tools.src.pkg', 8),
            ('method', 'Runner', 'go', '', 'cached', 'str,getcwd,loads', 'tools.src.pkg', 12),
            ('method', 'run', 'main', '', '', 'go,Runner', 'tools.src.pkg', 16),
        ],
    ),
    "u10_pipelines": (
        "name VARCHAR, retrievers INTEGER, oversample INTEGER, rerankers INTEGER, available BOOLEAN",
        [
            ('auto', 0, 1, 0, True),
            ('hybrid', 2, 1, 1, True),
            ('hybrid-ce-merge', 2, 1, 1, True),
            ('hybrid-diverse', 2, 3, 1, True),
            ('hybrid-reranked', 2, 1, 2, True),
            ('hybrid-reranked-diverse', 2, 3, 2, True),
            ('hybrid-rrf', 2, 1, 1, True),
            ('keyword', 1, 1, 0, True),
            ('unified', 1, 1, 1, True),
            ('vector', 1, 1, 1, True),
        ],
    ),
    "s12_more_languages": (
        "path VARCHAR, kind VARCHAR, owner VARCHAR, name VARCHAR, params VARCHAR, calls VARCHAR, package VARCHAR, imports VARCHAR, comment VARCHAR, line INTEGER, end_line INTEGER",
        [
            ('C.cs', 'class', '', 'Store', '', '', 'App.Core', 'System.Text', '', 4, 4),
            ('C.cs', 'method', 'Store', 'Clear', '', '', 'App.Core', 'System.Text', '', 10, 10),
            ('E.hs', 'class', '', 'Tree', '', '', 'Data.Tree', 'Data.Map', '', 4, 4),
            ('E.hs', 'class', '', 'a', '', '', 'Data.Tree', 'Data.Map', '', 5, 5),
            ('E.hs', 'method', 'a', 'grow', '', '', 'Data.Tree', 'Data.Map', '', 7, 7),
            ('H.vb', 'class', '', 'Cart', '', '', 'Shop', 'System.IO', '', 3, 3),
            ('H.vb', 'method', 'Cart', 'Add', 'Integer', 'Total', 'Shop', 'System.IO', '', 4, 6),
            ('H.vb', 'method', 'Cart', 'Clear', '', 'Drop', 'Shop', 'System.IO', '', 7, 9),
            ('a.scala', 'class', '', 'Point', '', '', 'x.y', 'a.b.C', 'Adds.', 5, 5),
            ('a.scala', 'class', '', 'Run', '', '', 'x.y', 'a.b.C', '', 10, 10),
            ('a.scala', 'method', 'Point', 'add', 'other,n', 'make', 'x.y', 'a.b.C', '', 6, 8),
            ('a.scala', 'method', 'Run', 'main', 'args', 'start', 'x.y', 'a.b.C', '', 11, 13),
            ('b.swift', 'class', '', 'Drawn', '', '', '', 'UIKit', '', 3, 3),
            ('b.swift', 'class', '', 'View', '', '', '', 'UIKit', '', 5, 5),
            ('b.swift', 'method', 'View', 'make', 's', 'build', '', 'UIKit', '', 6, 8),
            ('d.fs', 'class', '', 'Cart', '', '', 'Shop.Cart', 'System', '', 4, 4),
            ('d.fs', 'method', 'Cart', 'Add', 'item,n', 'total', 'Shop.Cart', 'System', '', 5, 8),
            ('d.fs', 'method', 'Cart', 'sum', '', '', 'Shop.Cart', 'System', '', 9, 11),
            ('f.ex', 'class', '', 'Shop.Cart', '', '', 'Shop.Cart', 'Shop.Item', '', 1, 1),
            ('f.ex', 'method', 'Shop.Cart', 'add', 'cart,item', 'push', 'Shop.Cart', 'Shop.Item', '', 4, 6),
            ('f.ex', 'method', 'Shop.Cart', 'total', 'cart', '', 'Shop.Cart', 'Shop.Item', '', 8, 9),
            ('g.clj', 'class', '', 'Cart', '', '', 'shop.cart', 'clojure.set', '', 4, 4),
            ('g.clj', 'method', 'Cart', 'add', 'item', '', 'shop.cart', 'clojure.set', 'Adds.', 7, 8),
        ],
    ),
    "s26_python_node_cmake": (
        "path VARCHAR, tool VARCHAR, group_id VARCHAR, artifact_id VARCHAR, version VARCHAR, deps VARCHAR",
        [
            ('p/setup.py', 'python', 'python', 'my_lib', '1.2', 'python:numpy:1.2:runtime'),
            ('q/setup.cfg', 'python', 'python', 'conf_lib', '0.3', 'python:requests:2:runtime,python:click:runtime'),
            ('r/pyproject.toml', 'python', 'python', 'poet', '2.0', 'python:rich:13.1:runtime,python:attrs:22:runtime'),
            ('s/package.json', 'node', 'npm', 'plain', 'unknown', 'npm:left-pad:1.0:runtime,npm:u:^2:runtime'),
            ('v/CMakeLists.txt', 'cmake', 'cmake', 'big.thing', 'unknown', ''),
        ],
    ),
}


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    """Each table as SQL."""
    out = {}
    for name, (columns, rows) in EXPECTED.items():
        kinds = [c.rsplit(" ", 1) for c in columns.split(", ")]
        values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
        casts = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in kinds)
        names = ", ".join(f'"{c}"' for c, _ in kinds)
        out[name] = f"SELECT {casts} FROM (VALUES {values}) v({names})"
    return out
