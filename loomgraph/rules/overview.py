"""Rules of the overview, most of them over the totals of a whole repository.

Shares are compared by products, so that no condition divides.
"""

from __future__ import annotations

from .base import FN, SRC, Rule, has, like

# Words of names and paths.
_API_STEMS = ("api", "route", "routes", "router", "routers", "endpoint", "endpoints", "view", "views", "handler", "handlers", "controller", "controllers", "resource", "resources", "schema", "schemas", "serializer", "serializers")
_KEEPER_ENDS = ("manager", "registry", "pool", "cache", "singleton", "store", "repository", "repo", "hub", "bus", "broker", "container", "context", "session")
_FLOW_WORDS = ("pipeline", "processor", "etl", "transform", "ingestion", "enrichment")
_PLUGIN_FOLDERS = ("plugins", "extensions", "addons", "modules", "extras", "contrib")

# id, condition on the totals, label
_REPOSITORY = [
    # sizes and complexity
    ("S82", "fns >= 5", "sizes of functions"),
    ("S93", "src_cx >= 10 AND cx_files >= 5 AND 100 * top_cx >= 60 * src_cx", "complexity lies in three files"),
    ("S100", "cx_fns >= 10", "median complexity"),
    ("S110", "src >= 5 AND src_lines >= 50 * src", "average file of 50 lines"),
    ("S125", "cx_fns >= 5 AND max_cx >= 15", "most complex function"),
    ("S137", "body_fns >= 10 AND body_lines >= 40 * body_fns", "average function of 40 lines"),
    ("S526", "src >= 5 AND src_lines >= 200 * src", "dense files"),
    ("S619", "src >= 5 AND src_lines >= 201 * src", "average file beyond 200 lines"),
    ("S655", "branch_fns >= 10 AND branch_cx >= 6 * branch_fns", "average complexity beyond 5"),
    ("S775", "src >= 3 AND src_lines >= 200 * src", "average file of 200 lines"),
    ("S781", "src >= 5 AND src_lines < 10 * src", "many small files"),
    ("S811", "src > 0 AND src_lines > 300 * src", "average file beyond 300 lines"),
    ("S847", "src >= 10 AND small_src = src", "only files below 20 lines"),
    ("S403", "code_src >= 4 AND code_lines > 0 AND 2 * max_code_lines >= code_lines", "one file holds half of the lines"),
    # coupling
    ("S227", "src >= 5 AND src_out >= 5 * src", "five imports a file"),
    ("S258", "code_src >= 10 AND src_out >= 5 * code_src", "five imports a code file"),
    ("S286", "code_src >= 8 AND src_out < code_src", "less than an import a code file"),
    ("S582", "src >= 5 AND src_links = 0", "no imports between sources"),
    ("S625", "src >= 5 AND syms > 0 AND src_links = 0 AND 100 * exported >= 70 * syms", "exported, yet never imported"),
    ("S679", "src >= 4 AND 10 * orphans > 3 * src", "many files that nothing imports"),
    ("S715", "py_src >= 4 AND 10 * max_py_importers > 4 * (py_src - 1)", "hub file"),
    ("S787", "src >= 4 AND max_importers > 0 AND 2 * max_importers >= src", "half of all files import one"),
    ("S889", "max_importers >= 5", "file of high fan-in"),
    ("S129", "modules >= 3 AND orphan_modules >= 2", "modules that no other imports"),
    # layout
    ("S134", "modules >= 3 AND top_module >= 3", "largest module"),
    ("S157", "src + tests >= 2 AND max_depth >= 4", "deepest path"),
    ("S259", "code_src >= 8 AND root_code = code_src", "all code at the root"),
    ("S421", "code_src >= 8 AND root_code = code_src", "no folders of code"),
    ("S348", "top_folder >= 20", "folder of twenty sources"),
    ("S349", "code_src >= 10 AND 2 * tiny_code >= code_src", "half of the files hold two symbols or less"),
    ("S379", "code_src >= 10 AND 10 * deep_code >= 3 * code_src", "a third of the files three folders deep"),
    ("S506", "max_depth >= 3", "sources three folders deep"),
    ("S601", "root_py >= 10", "ten files at the root"),
    ("S661", "max_depth >= 4", "paths of five parts"),
    ("S733", "py_src >= 5 AND root_py = py_src", "all files at the root"),
    ("S793", "src >= 5 AND 2 * deep_src > src", "most files three folders deep"),
    ("S835", "src > 0 AND sum_depth >= 3 * src", "average depth of three folders"),
    ("S901", "src >= 5 AND root_src = src", "one root folder"),
    ("S961", "src >= 8 AND root_src = src", "flat architecture"),
    ("S727", "py_src = 1", "single file"),
    ("S709", "src >= 4 AND top > 0 AND src > 3 * top", "three files a symbol"),
    ("S859", "src >= 5 AND 2 * wide_src >= src", "half of the files hold five functions"),
    ("S489", "defs >= 20 AND 10 * max_defs >= 3 * defs", "god module"),
    ("S883", "defs >= 6 AND 2 * max_defs >= defs", "monolith file"),
    ("S1015", "src >= 2 AND 2 * max_symbols > syms", "dominant file"),
    ("S673", "top_any > 0 AND 10 * max_top > 3 * top_any", "file with a third of all symbols"),
    # languages
    ("S445", "code_langs >= 3", "several languages in use"),
    ("S553", "code_langs >= 3", "mixed source languages"),
    ("S507", "code_src >= 10 AND 10 * top_language >= 9 * code_src", "nearly one language"),
    ("S588", "src_langs = 1 AND src >= 3", "one language"),
    ("S805", "prose_free_langs >= 3", "three programming languages"),
    ("S925", "py_src >= 2 AND js >= 2", "Python beside JavaScript"),
    ("S1009", "langs >= 3", "three languages"),
    # tests
    ("S115", "tests >= 2 AND max_test_named >= 3", "largest test file"),
    ("S151", "test_lines > 0 AND src_lines >= 10 AND src_lines >= 5 * test_lines", "five times the lines of tests"),
    ("S213", "code_src + code_tests >= 5 AND 10 * code_tests >= 6 * (code_src + code_tests)", "high share of tests"),
    ("S233", "code_src + code_tests >= 10 AND code_src > 0 AND 10 * code_tests < 2 * (code_src + code_tests)", "low share of tests"),
    ("S271", "code_src >= 5 AND tests >= 10 AND tests > 2 * code_src", "twice as many tests as sources"),
    ("S322", "src >= 10 AND src >= 3 * tests", "three times as many sources as tests"),
    ("S355", "code_tests >= 3 AND code_src = 0", "nothing but tests"),
    ("S373", "code_tests >= 5 AND 2 * thin_tests >= code_tests", "half of the test files hold two tests or less"),
    ("S391", "code_src >= 3 AND code_tests = 0", "no tests of the code"),
    ("S452", "lined_src > 500 AND 10 * test_lines < 2 * lined_src", "thin tests"),
    ("S469", "test_fns >= 10 AND short_test_fns = test_fns", "only short tests"),
    ("S532", "src + tests >= 10 AND 2 * tests > src + tests", "more tests than sources"),
    ("S547", "src >= 5 AND tests = 0", "five sources without tests"),
    ("S565", "src >= 3 AND tests >= 3 AND src_lines > 0 AND test_lines >= 2 * src_lines", "twice the lines of sources in tests"),
    ("S637", "top_any >= 5 AND test_top_any >= 3 * top_any", "three times the symbols in tests"),
    ("S667", "tests = 0 AND src >= 3", "no test file"),
    ("S697", "top >= 5 AND test_top > 0 AND top >= 5 * test_top", "five symbols for one of the tests"),
    ("S745", "tests >= 2 AND test_syms > 0 AND 5 * max_test_syms > 4 * test_syms", "tests lie in one file"),
    ("S751", "tests = 1 AND top >= 5", "single test file"),
    ("S823", "src >= 3 AND tests >= 2 * src", "two tests a source"),
    ("S871", "tests = 0 AND src >= 5", "five files, no test file"),
    ("S913", "src >= 3 AND tests >= 2 * src", "test-heavy files"),
    ("S967", "tests = 0 AND src >= 3", "three sources, no test file"),
    ("S997", "top_functions >= 2 AND test_cases >= 3 * top_functions", "three tests a function"),
    # exports and documentation
    ("S173", "syms >= 20 AND 10 * (syms - exported) >= 8 * syms", "mostly private"),
    ("S203", "exported_api >= 10 AND 2 * bare_api >= exported_api", "half of the exports undocumented"),
    ("S385", "code_api >= 15 AND 10 * idle_code_api >= 3 * code_api", "a third of the exports unused"),
    ("S571", "src >= 5 AND exported = 0", "nothing exported"),
    ("S594", "src >= 5 AND exported_classes = 0", "no exported class"),
    ("S631", "src >= 5 AND exported_functions >= 10 AND exported_classes = 0", "procedural style"),
    ("S649", "exported_classes >= 5 AND 10 * exported_errors >= 2 * exported_classes", "a fifth of the classes are exceptions"),
    ("S817", "public_functions >= 10 AND told_functions = 0", "no public function documented"),
    ("S877", "exported_fns >= 5 AND 10 * bare_fns >= 7 * exported_fns", "most exported functions undocumented"),
    ("S949", "top_defs >= 5 AND public_defs = 0", "all private"),
    ("S481", "fns >= 20 AND 10 * idle_fns >= 3 * fns", "a third of the functions unreferenced"),
    ("S607", "defs >= 10 AND 10 * uncalled_defs > 3 * defs", "a third of the symbols uncalled"),
    ("S853", "public_top >= 10 AND 10 * dead_top >= 4 * public_top", "two fifths of the public symbols unused"),
    # styles
    ("S324", "code_fns >= 10 AND 10 * stub_fns >= 2 * code_fns", "a fifth of the functions are stubs"),
    ("S336", "code_functions >= 5 AND code_classes >= 2 * code_functions", "mostly classes"),
    ("S409", "syms >= 10 AND 10 * consts >= 4 * syms", "two fifths constants"),
    ("S427", "classes >= 2 AND class_methods >= 10 * classes", "ten methods a class"),
    ("S769", "classes >= 2 AND class_fns >= 10 * classes", "ten functions a class"),
    ("S433", "script_src >= 10 AND exported_async = 0", "no asynchronous code"),
    ("S514", "async_fns >= 3 AND sync_fns >= 3", "synchronous beside asynchronous"),
    ("S685", "top >= 5 AND 10 * top_classes > 6 * top", "class-heavy"),
    ("S691", "top >= 5 AND 10 * top_consts > 2 * top", "a fifth of the top level is state"),
    ("S739", "fns > 0 AND consts > 2 * fns", "twice as many constants as functions"),
    ("S757", "top_fns >= 3 AND top_consts >= 2 * top_fns", "constants dominate the top level"),
    ("S763", "classes = 0 AND top_fns >= 5", "no class"),
    ("S829", "functions >= 5 AND top_consts = 0", "no constants of modules"),
    ("S841", "functions >= 10 AND async_functions = 0", "ten functions, none asynchronous"),
    ("S907", "fns >= 5 AND constants > fns", "more constants than functions"),
    ("S937", "fns >= 5 AND constants = 0", "no constants"),
    ("S943", "top_functions >= 5 AND methods = 0", "functions only"),
    ("S973", "top_classes = 1 AND top_functions >= 10", "lone class"),
    ("S979", "classes = 0 AND top_functions >= 5", "functions without a class"),
    # beginnings
    ("S220", "entries >= 3", "several entry files"),
    ("S280", "entries >= 5", "five entry files"),
    ("S520", "src >= 8 AND entries = 0", "no entry file"),
    ("S415", "entry_files >= 3", "several files define an entry"),
    ("S463", "src >= 5 AND entry_fns = 0", "no function starts the program"),
    ("S559", "entry_bases = 1", "single entry file"),
    ("S721", "src + tests >= 3 AND starting_files = 0", "no file with the name of an entry"),
    ("S799", "idle_entries = 1 AND src >= 5", "one entry function"),
    ("S919", "top_fns >= 5 AND starting_fns = 0", "no function that starts or runs"),
    ("S985", "functions >= 5 AND starting_functions = 0", "no function with the name of an entry"),
]

OVERVIEW: list[Rule] = [
    *[Rule("overview", i, "repository", condition, 1, label) for i, condition, label in _REPOSITORY],
    *[Rule("overview", i, "mutual", "file_path < partner", 1, label) for i, label in (("S185", "files that import each other"), ("S613", "circular imports"), ("S895", "circular import pair"))],
    Rule("overview", "S146", "file", f"{SRC} AND src_imports >= 5", 2, "aggregators of five imports"),
    Rule("overview", "S161", "file", f"{SRC} AND importers - test_importers >= 10", 1, "hub files"),
    Rule("overview", "S179", "file", f"{SRC} AND test_named > 0", 1, "sources with tests in them"),
    Rule("overview", "S191", "file", f"{SRC} AND interface >= 3 AND interface_exported = interface", 2, "files that only export"),
    Rule("overview", "S226", "file", f"{SRC} AND symbols >= 50", 1, "monolithic files"),
    Rule("overview", "S247", "file", f"{SRC} AND code AND {like('stem', *_API_STEMS)}", 3, "files of interfaces"),
    Rule("overview", "S306", "file", f"{SRC} AND " + like("concat('/', lower(folder), '/')", *[f"%/{w}/%" for w in _PLUGIN_FOLDERS]), 5, "files in folders of plugins"),
    Rule("overview", "S330", "file", f"{SRC} AND {has('lower(file_path)', *_FLOW_WORDS)}", 5, "data pipelines"),
    Rule("overview", "S1003", "file", f"{SRC} AND depth >= 3", 1, "sources in deep folders"),
    Rule("overview", "S84", "symbol", f"{SRC} AND exported AND {FN} AND cross_files > 0 AND test_callers = 0", 3, "called exports without a test"),
    Rule("overview", "S86", "symbol", f"{SRC} AND exported AND {FN} AND callers > 0 AND test_callers = callers", 2, "exports that only tests call"),
    Rule("overview", "S154", "symbol", f"{SRC} AND NOT exported AND {FN} AND callers = 1 AND cross_files = 0", 5, "private functions with one caller"),
    Rule("overview", "S197", "symbol", f"{SRC} AND kind IN ('constant', 'variable')", 20, "many constants"),
    Rule("overview", "S252", "symbol", f"{SRC} AND kind IN ('function', 'method', 'class') AND src_files >= 10", 1, "god symbols"),
    Rule("overview", "S255", "symbol", f"{SRC} AND kind = 'class' AND {like('low', *[f'%{w}' for w in _KEEPER_ENDS])}", 3, "classes that keep global state"),
    Rule("overview", "S274", "symbol", f"{SRC} AND kind = 'class' AND code", 20, "many classes"),
    Rule("overview", "S643", "symbol", f"{SRC} AND grandparents > 0", 1, "classes with a grandparent"),
    Rule("overview", "S865", "symbol", f"{SRC} AND kind = 'class' AND {like('name', 'Abstract%', 'Base%', '%ABC')}", 3, "abstract classes"),
    Rule("overview", "S931", "symbol", f"{SRC} AND kind IN ('function', 'class') AND parent_id IS NULL AND left(name, 1) <> '_'", 20, "large public interface"),
    Rule("overview", "S955", "symbol", f"{SRC} AND kind = 'function' AND parent_id IS NULL AND lines >= 200", 1, "functions of 200 lines"),
    Rule("overview", "S991", "symbol", f"{SRC} AND methods >= 8", 1, "god classes"),
]
