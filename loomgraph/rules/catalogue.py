"""The rules: mode, id, scope, condition on one row, least number of rows, label.

Conditions are SQL that Spark and DuckDB read alike.  A rule fires when at
least so many rows of its scope meet its condition; ids repeat over modes, so a
rule's name is its mode and id.
"""

from __future__ import annotations

from .base import FN as _FN
from .base import SRC as _SRC
from .base import Rule
from .base import has as _has
from .base import like as _like
from .base import word as _word
from .diff import DIFF
from .overview import OVERVIEW

# Name families of unused functions, as (id, patterns, least, label).
_DEAD = [
    ("S232", ("%serialize%", "to_dict%", "from_dict%", "to_json%"), 1, "unused serializers"), ("S298", ("middleware_%", "interceptor_%", "before_%", "after_%"), 2, "unused middleware"),
    ("S432", ("subscribe_%", "listen_%", "watch_%"), 2, "unused subscriptions"),
    ("S959", ("hook_%", "%_hook"), 1, "unused hooks"),
]
# File families, as (id, patterns of lower-case base names, least, label).
_DIFF = [
    ("S240", ("changelog%", "history%", "release%"), 1, "release notes changed"),
    ("S319", ("requirements%", "package.json", "pyproject.toml", "cargo.toml", "go.mod"), 1, "dependencies changed"), ("S441", ("%serial%", "%schema%"), 1, "serialization changed"),
    
]
_BLAST = [
    ("S261", ("%windows%", "%linux%", "%darwin%", "%android%", "%ios%"), "platform-specific file"),
]

# More name families of unused functions.
_DEAD_MORE = [
    ("S202", 1, "unused error handlers", ("handle_%", "on_error%", "catch_%", "except_%", "%error_handler%", "%_error")),
    ("S208", 1, "unused callbacks and listeners", ("%_callback", "%_handler", "%_listener", "%_hook",)),
    ("S218", 1, "unused initializers", ("init_%", "initialize_%", "setup_app%", "configure_%", "bootstrap_%", "startup_%",)),
    ("S225", 2, "unused validators", ("validate_%", "check_%", "verify_%", "assert_%", "ensure_%",)),
    ("S238", 1, "unused request hooks", ("middleware_%", "before_%", "after_%", "pre_%", "post_%", "intercept_%", "filter_%",)),
    ("S241", 2, "unused configuration readers", ("config_%", "settings_%", "get_config%", "load_config%", "get_setting%", "load_settings%",)),
    ("S264", 2, "unused commands", ("cmd_%", "command_%", "do_%", "run_cmd%", "execute_%", "action_%",)),
    ("S291", 3, "unused readers", ("get_%", "fetch_%", "retrieve_%", "load_%", "read_%", "query_%",)),
    ("S310", 2, "unused adapters", ("adapt_%", "adapter_%", "convert_%", "converter_%", "transform_%", "format_%",)),
    ("S315", 2, "unused rate limiters", ("rate_limit_%", "throttle_%", "debounce_%", "quota_%",)),
    ("S321", 1, "unused authentication", ("auth_%", "authenticate_%", "authorize_%", "check_auth%", "require_auth%",)),
    ("S329", 2, "unused notifications", ("notify_%", "send_notification%", "alert_%", "dispatch_event_%", "publish_%",)),
    ("S335", 2, "unused state handlers", ("on_enter_%", "on_exit_%", "on_leave_%", "transition_%", "state_%",)),
    ("S341", 2, "unused scheduled tasks", ("task_%", "cron_%", "scheduled_%", "periodic_%", "job_%",)),
    ("S347", 1, "unused migration helpers", ("migrate_%", "upgrade_%", "downgrade_%", "rollback_%",)),
    ("S378", 2, "unused parsers", ("parse_%", "decode_%", "deserialize_%", "from_string_%", "load_from_%",)),
    ("S384", 2, "unused cleanup", ("cleanup_%", "teardown_%", "destroy_%", "shutdown_%", "close_%", "dispose_%",)),
    ("S390", 2, "unused reports", ("report_%", "generate_%", "export_%", "build_report_%", "render_report_%",)),
    ("S396", 2, "unused logging", ("log_%", "debug_%", "trace_%", "write_log_%", "record_event_%",)),
    ("S414", 2, "unused converters", ("map_%", "translate_%", "convert_%", "transform_%",)),
    ("S426", 2, "unused decorators", ("register_%", "decorator_%", "with_%", "patch_%", "decorate_%",)),
    ("S456", 2, "unused formatters", ("format_%", "formatter_%", "pretty_%", "display_%",)),
    ("S468", 1, "unused encoders", ("serialize_%", "marshal_%", "encode_%", "dump_%",)),
    ("S480", 2, "unused debug helpers", ("dump_%", "print_debug_%", "trace_%", "verbose_%",)),
]
# Name families of unused classes.
_DEAD_CLASSES = [
    ("S248", 2, "unused exceptions", ("%error", "%exception", "%fault", "%failure",)),
    ("S257", 2, "unused data types", ("%schema", "%dto", "%request", "%response", "%payload",)),
    ("S586", 1, "unused services", ("%manager", "%service", "%controller", "%registry", "%repository", "%provider",)),
]
# More families of changed files.
_DIFF_MORE = [
    ("S615", 1, "secrets changed", (".env%", ".envrc", ".secret%", "%.pem", "%.key", "%.p12",)),
    ("S645", 1, "lock files changed", ("pipfile.lock", "poetry.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "gemfile.lock",)),
    ("S657", 1, "build configuration changed", ("jenkinsfile", "makefile", "dockerfile", ".travis.yml", "circle.yml", "azure-pipelines.yml",)),
    ("S849", 1, "shared utilities changed", ("%utils%", "%helpers%", "%common%", "%shared%", "%core%",)),
    ("S855", 1, "legacy files changed", ("%_old%", "%_legacy%", "%_deprecated%", "%_bak%",)),
    ("S981", 1, "security files changed", ("%auth%", "%security%", "%crypto%",)),
    ("S235", 1, "interface contracts changed", ("%.proto", "%.graphql", "%.gql", "%.avro",)),
    ("S339", 1, "feature flags changed", ("%feature_flag%", "%toggle%", "%rollout%", "%flags%",)),
    ("S345", 1, "performance code changed", ("%cache%", "%query%", "%index%", "%performance%", "%benchmark%",)),
    ("S357", 1, "translations changed", ("%locale%", "%i18n%", "%l10n%", "%translation%",)),
    ("S381", 1, "scripts changed", ("%.sh", "%.bash", "%.zsh", "%.ps1", "%.bat",)),
    ("S387", 1, "public interfaces changed", ("%routes%", "%endpoints%", "%api%", "%openapi%", "%swagger%",)),
    ("S399", 1, "error handling changed", ("%error_handler%", "%exception_handler%", "%retry%", "%fallback%", "%circuit_breaker%",)),
    ("S491", 1, "test fixtures changed", ("conftest.py", "fixtures.py", "test_helpers.py", "test_utils.py",)),
    ("S509", 1, "entities changed", ("%model%", "%entity%", "%orm%", "%record%", "%domain%",)),
    ("S579", 1, "media changed", ("%.png", "%.jpg", "%.jpeg", "%.gif", "%.ico", "%.svg", "%.webp",)),
    ("S584", 1, "version changed", ("version.py", "_version.py", "version", "version.txt",)),
]

# File families by a word that stands anywhere in the base name without its extension.
_BLAST_HAS = [
    ("S722", "utility name", ("util", "helper", "common", "shared", "base", "mixin")),
    ("S734", "data model", ("model", "schema", "entity", "dto", "domain")),
    ("S740", "wraps other code", ("middleware", "decorator", "wrapper", "interceptor", "hook")),
    ("S746", "client of a service", ("client",)),
    ("S758", "routing file", ("router", "routes", "routing", "urls", "url_conf", "endpoint", "endpoints")),
    ("S866", "database migration", ("migration", "migrate", "upgrade", "downgrade", "alembic")),
    ("S872", "encoding of data", ("serial", "format", "codec", "marshal", "encode", "decode", "schema")),
    ("S878", "settings by name", ("config", "settings", "conf", "setup", "options", "params")),
    ("S884", "security-sensitive file", ("auth", "token", "secret", "credential", "password", "jwt", "oauth", "crypto", "session")),
    ("S896", "events and messages", ("handler", "listener", "subscriber", "receiver", "consumer", "event", "message", "queue")),
    ("S902", "request entry by name", ("route", "router", "endpoint", "controller", "view", "urls", "api")),
    ("S920", "cache or session store", ("cache", "redis", "memcache", "session", "store", "buffer")),
    ("S926", "request pipeline", ("middleware", "interceptor", "filter", "guard", "hook", "pipeline", "chain")),
    ("S932", "base library", ("util", "helper", "common", "shared", "lib", "base", "mixin")),
]
# File families by a word alone, or first or last in such a name.
_BLAST_WORD = [
    ("S770", "constants or settings", ("constants", "consts", "settings", "config", "configuration", "defaults", "env")),
    ("S800", "registry of plugins", ("plugin", "plugins", "registry", "register", "hooks", "extensions", "middleware")),
    ("S812", "constants, silently used", ("constants", "constant", "config", "settings", "conf", "consts", "vars", "env")),
    ("S842", "constants or parameters", ("constants", "config", "settings", "conf", "defaults", "env", "params")),
    ("S938", "loader or parser", ("loader", "load", "parser", "parse", "reader", "importer", "import_")),
    ("S950", "context helper", ("context", "ctx", "contextlib", "contextmanager", "scope", "transaction")),
    ("S962", "dispatch of addresses", ("router", "routes", "urls", "routing", "endpoints", "paths")),
    ("S974", "data access", ("store", "storage", "repository", "repo", "dao", "data_access", "persistence")),
    ("S980", "caching layer", ("cache", "cached", "caching", "memoize", "memoization", "redis", "memcache", "memcached")),
    ("S986", "configuration", ("config", "configuration", "settings", "env", "environment", "options", "params", "parameters", "defaults", "conf")),
    ("S992", "definitions of entities", ("schema", "schemas", "model", "models", "entity", "entities", "types", "typedefs", "datamodel", "domain")),
    ("S1004", "security module", ("auth", "authentication", "authorization", "security", "credentials", "crypto", "password", "passwords", "token", "tokens", "session", "sessions", "permission", "permissions", "acl", "oauth", "jwt")),
    ("S1010", "serializer", ("serializer", "serializers", "marshal", "marshaller", "codec", "codecs", "encoder", "encoders", "decoder", "decoders")),
    ("S1016", "background work", ("task", "tasks", "job", "jobs", "worker", "workers", "celery", "queue", "queues", "scheduler", "beat")),
]
# File families by the whole base name, with the least number of importers.
_BLAST_BASE = [
    ("S231", 0, "package file", ("__init__.py", "__init__.ts", "__init__.js")),
    ("S343", 1, "shared fixtures that others import", ("conftest.py", "fixtures.py", "test_helpers.py", "test_utils.py")),
    ("S496", 1, "imported package file", ("__init__.py",)),
    ("S554", 0, "application entry point", ("main.py", "app.py", "server.py", "cli.py", "run.py", "wsgi.py", "asgi.py")),
    ("S589", 0, "package file by its end", ("__init__.py",)),
    ("S626", 0, "utility module", ("utils.py", "helpers.py", "util.py", "helper.py", "common.py", "misc.py", "shared.py")),
    ("S674", 0, "entry point, wider list", ("main.py", "app.py", "server.py", "cli.py", "__main__.py", "entrypoint.py", "entry.py", "wsgi.py", "asgi.py", "run.py")),
    ("S716", 0, "settings or errors", ("config.py", "settings.py", "constants.py", "exceptions.py", "errors.py")),
    ("S728", 0, "package initializer", ("__init__.py",)),
]
# Other name lists of files.
_ENTRY_STEMS = ("main", "app", "index", "server", "cli", "run", "manage", "wsgi", "asgi", "__main__")
_COMMAND_STEMS = ("__main__", "cli", "main", "entrypoint", "entry_point", "run")
_UTILITY_STEMS = ("utils", "util", "helpers", "helper", "shared", "common", "base", "core", "lib", "tools")
_TEST_STEMS = ("test_utils", "test_helpers", "test_fixtures", "conftest", "fixtures", "factories")
_API_FOLDERS = ("api", "views", "endpoints", "routes", "controllers", "handlers")
_SHARED_FOLDERS = ("/shared/", "/common/", "/core/", "/lib/", "/base/", "/foundation/")
_CONFIG_WORDS = ("config", "settings", "constants", "conf", "env")
_UTILITY_WORDS = ("utils", "helpers", "util", "helper", "common", "shared", "misc")
_CHURN_WORDS = ("handler", "router", "route", "controller", "middleware", "dispatch", "gateway", "proxy", "adapter", "bridge")
_DATA_WORDS = ("db", "database", "orm", "model", "migration", "repo", "repository", "dao", "query")
_FIXTURE_BASES = ("conftest.py", "fixtures.py", "factories.py", "test_helpers.py", "test_utils.py")
# Name lists for the file of the top hotspot.
_TOP_DATA = ("dao", "repository", "repo", "model", "orm", "schema", "database", "db")
_TOP_GENERATED = ("_gen.", "_generated.", ".gen.", ".generated.", "generated_", "autogenerated")
_TOP_WRAPPERS = ("wrapper", "adapter", "proxy", "facade", "bridge", "client")
_TOP_LEGACY = ("%_old", "%_legacy", "%_deprecated", "%_v1", "%_bak")
_TOP_ENTRIES = ("main.py", "app.py", "server.py", "index.py", "run.py", "cli.py", "__main__.py", "wsgi.py", "asgi.py")

_PATH = "lower(file_path)"
_FOLDERS = "length(file_path) - length(replace(file_path, '/', ''))"  # above the file
_PRIVATE = "left(name, 1) = '_' AND left(name, 2) <> '__'"
_MIXED_CASE = "regexp_replace(file_path, '^.*/', '')"  # the base name as it is written
_IN_API = _like(f"concat('/', {_PATH})", *[f"%/{w}/%" for w in _API_FOLDERS])

# Families whose names are compared as written, at a confidence of 40 or more.
_SURE = ("S202", "S208", "S218", "S225", "S232", "S238", "S248", "S257", "S264", "S270", "S285", "S291")
# Families at a confidence of 40 or more in any case.  All others need 30.
_SURE_ANY_CASE = ("S241", "S321", "S493")
# Beginnings of the names of unused functions.
_DEAD_PREFIX = [
    ("S270", 2, "unused event functions", ("on_%", "handle_%", "listener_%", "observer_%", "subscriber_%", "on_message%", "on_event%", "on_change%", "on_error%", "on_connect%")),
    ("S285", 2, "unused object factories", ("create_%", "make_%", "build_%", "construct_%", "instantiate_%", "new_%", "factory_%", "get_or_create_%")),
    ("S297", 3, "three unused validators", ("validate_%", "check_%", "verify_%", "ensure_%", "assert_%", "is_valid_%")),
    ("S354", 2, "unused makers", ("create_%", "make_%", "build_%", "construct_%", "new_%", "factory_%", "spawn_%")),
    ("S360", 2, "unused event hooks", ("on_%", "handle_%", "listen_%", "when_%", "after_%", "before_%", "on_event_%", "event_handler_%", "process_event_%")),
    ("S402", 2, "unused background work", ("background_task_%", "worker_%", "celery_%", "task_%", "async_job_%", "queue_%", "job_%")),
    ("S408", 2, "unused checks", ("validate_%", "check_%", "verify_%", "assert_%", "ensure_%", "is_valid_%", "sanitize_%")),
    ("S420", 2, "unused schedules", ("schedule_%", "cron_%", "periodic_%", "run_every_%", "hourly_%", "daily_%", "weekly_%", "nightly_%")),
    ("S438", 1, "unused migration steps", ("migrate_%", "migration_%", "upgrade_%", "downgrade_%", "apply_migration_%", "run_migration_%")),
    ("S444", 1, "unused command functions", ("main_%", "cmd_%", "cli_%", "command_%", "run_command_%", "handle_command_%")),
    ("S450", 1, "unused recovery from errors", ("handle_error_%", "handle_exception_%", "on_error_%", "on_exception_%", "except_%", "catch_%", "recover_%")),
    ("S462", 2, "unused assertions", ("validate_%", "check_%", "verify_%", "assert_%", "ensure_%", "is_valid_%")),
    ("S474", 1, "unused beginnings", ("setup_%", "initialize_%", "init_%", "bootstrap_%", "configure_%", "startup_%")),
    ("S493", 2, "unused receivers", ("on_%", "handle_%", "listen_%", "when_%", "on_event_%", "receive_%", "dispatch_%")),
]
# The same at any confidence, and whether only functions outside of classes count.
_DEAD_ANY = [
    ("S629", False, "unwired callbacks", ("%_callback", "%_handler", "%_listener", "%_hook", "%_receiver", "%_observer")),
    ("S695", False, "test utilities among sources", ("%mock%", "%stub%", "%fake%", "%fixture%")),
    ("S707", False, "unwired handlers", ("on_%", "handle_%", "%_handler", "%_listener", "%_callback")),
    ("S761", False, "unwired subscribers", ("on_%", "handle_%", "listener_%", "subscriber_%")),
    ("S767", False, "unused look-ups", ("get_%", "fetch_%", "load_%", "retrieve_%", "find_%")),
    ("S779", False, "unused dispatch", ("dispatch%", "route_%", "route", "handle_request%", "process_%", "process", "execute_%", "execute")),
    ("S827", False, "unused data migrations", ("migrate_%", "upgrade_%", "rollback_%", "revert_%", "downgrade_%")),
    ("S845", False, "unused reactions", ("on_%", "handle_%", "%_handler", "%_callback", "%_listener")),
    ("S851", False, "validation that nothing runs", ("validate_%", "check_%", "verify_%", "assert_%", "ensure_%")),
    ("S857", False, "construction that nothing runs", ("create_%", "make_%", "build_%", "spawn_%", "new_%", "construct_%")),
    ("S887", True, "unused interceptors", ("middleware_%", "interceptor_%", "filter_%", "before_%", "after_%", "pre_%", "post_%", "%middleware%", "%interceptor%")),
    ("S917", True, "unused call-backs", ("on_%", "handle_%", "callback_%", "cb_%", "%callback%", "%_cb%")),
    ("S923", True, "unused rendering", ("format_%", "render_%", "display_%", "to_%", "fmt_%", "stringify_%")),
    ("S941", True, "unused set-up", ("configure_%", "setup_%", "init_%", "initialize_%", "bootstrap_%", "register_%")),
    ("S953", False, "unused exports of data", ("to_dict%", "to_json%", "to_yaml%", "to_csv%", "to_xml%", "serialize_%", "marshal_%", "export_%")),
    ("S965", True, "unused timed work", ("schedule_%", "cron_%", "task_%", "job_%", "periodic_%", "daily_%", "hourly_%")),
    ("S971", True, "unused conversions", ("convert_%", "transform_%", "map_%", "parse_%", "translate_%", "normalize_%")),
    ("S977", True, "unused database functions", ("sql_%", "query_%", "select_%", "fetch_%", "insert_%", "delete_%", "update_%", "upsert_%")),
    ("S983", True, "unused senders", ("send_%", "notify_%", "emit_%", "dispatch_%", "publish_%", "broadcast_%", "fire_%", "trigger_%")),
    ("S989", True, "unused guards", ("validate_%", "check_%", "verify_%", "assert_%", "ensure_%", "guard_%", "is_valid_%", "must_%")),
    ("S995", True, "unused presentation", ("format_%", "fmt_%", "render_%", "display_%", "present_%", "show_%", "print_%", "stringify_%")),
    ("S1001", True, "unused builders", ("build_%", "create_%", "make_%", "construct_%", "new_%", "factory_%", "produce_%", "generate_%")),
    ("S1007", True, "unused error functions", ("handle_error%", "on_error%", "error_handler%", "handle_exception%", "on_exception%", "catch_error%", "rescue_%")),
    ("S1013", True, "unused schema changes", ("migrate_%", "migration_%", "upgrade_%", "downgrade_%", "rollback_%", "apply_migration%", "run_migration%")),
    ("S1019", True, "unused routes", ("route_%", "add_route%", "register_route%", "register_%", "add_url%", "add_view%", "add_endpoint%")),
]
# The same without callers, in files that nothing imports.
_DEAD_ALONE = [
    ("S551", "commands that nothing reaches", ("cmd_%", "do_%", "handle_%", "on_%", "command_%")),
    ("S563", "validators that nothing reaches", ("validate_%", "check_%", "verify_%", "assert_%", "ensure_%")),
]


def _unused(i: str, patterns: tuple[str, ...], n: int, label: str) -> Rule:
    """n functions outside of tests whose names meet patterns, at the confidence of their family."""
    column = "name" if i in _SURE else "low"
    least = 0 if i == "S959" else 40 if i in _SURE + _SURE_ANY_CASE else 30
    return Rule("dead", i, "symbol", f"confidence >= {least} AND {_SRC} AND {_FN} AND {_like(column, *patterns)}", n, label)


RULES: list[Rule] = [
    *OVERVIEW,
    *DIFF,
    *[Rule("blast", i, "file", _has("stem", *words), 1, label) for i, label, words in _BLAST_HAS],
    *[Rule("blast", i, "file", _word("stem", *words), 1, label) for i, label, words in _BLAST_WORD],
    *[Rule("blast", i, "file", f"{_like('base', *names)} AND importers >= {n}", 1, label) for i, n, label, names in _BLAST_BASE],
    Rule("blast", "S183", "file", "exported_api >= 10", 1, "files with a wide public interface"),
    Rule("blast", "S217", "file", _like("stem", *_ENTRY_STEMS), 1, "entry points of an application"),
    Rule("blast", "S224", "file", "is_test", 1, "test files, few dependents expected"),
    Rule("blast", "S237", "file", "symbols > 0 AND exported = 0", 1, "files without exports"),
    Rule("blast", "S290", "file", "exported > 0 AND importers = 0 AND NOT is_test", 1, "exports that no file imports"),
    Rule("blast", "S383", "file", f"{_like('base', *_FIXTURE_BASES)} AND test_importers >= 3", 1, "fixtures of three tests or more"),
    Rule("blast", "S413", "file", "symbols >= 30", 1, "files dense in symbols"),
    Rule("blast", "S459", "file", "exported_fns >= 20 AND importers >= 5", 1, "core utilities"),
    Rule("blast", "S467", "file", "test_importers > 0 AND test_importers = importers AND NOT is_test", 1, "sources that only tests import"),
    Rule("blast", "S473", "file", "constants = symbols AND symbols >= 5 AND importers > 0", 1, "imported files of constants only"),
    Rule("blast", "S511", "file", "importers = 1", 1, "files with one consumer"),
    Rule("blast", "S515", "file", _has(_PATH, *_CONFIG_WORDS), 1, "settings by path"),
    Rule("blast", "S527", "file", "exported >= 20", 1, "files with twenty exports"),
    Rule("blast", "S560", "file", "importers > 0 AND test_importers = importers", 1, "files that only tests import"),
    Rule("blast", "S566", "file", f"importers >= 5 AND {_has(_PATH, *_UTILITY_WORDS)}", 1, "widely used utilities"),
    Rule("blast", "S572", "file", "lines >= 300", 1, "files of 300 lines"),
    Rule("blast", "S578", "file", _like("concat('/', file_path, '/')", *[f"%{w}%" for w in _SHARED_FOLDERS]), 1, "files of shared folders"),
    Rule("blast", "S608", "file", _has("base", *_CHURN_WORDS), 1, "names that tend to change"),
    Rule("blast", "S662", "file", "lines > 300", 1, "files beyond 300 lines"),
    Rule("blast", "S680", "file", "is_test", 1, "tests as targets"),
    Rule("blast", "S710", "file", f"{_FOLDERS} >= 3", 1, "files three folders deep"),
    Rule("blast", "S776", "file", "importers - test_importers >= 10", 1, "files with ten importing sources"),
    Rule("blast", "S788", "file", _like("stem", *[p for w in _UTILITY_STEMS for p in (w, f"_{w}")]), 1, "shared utilities by exact name"),
    Rule("blast", "S794", "file", _like("stem", *_COMMAND_STEMS), 1, "command line entries"),
    Rule("blast", "S818", "file", "is_test", 1, "changed tests weaken the net"),
    Rule("blast", "S830", "file", f"{_MIXED_CASE} = '__init__.py'", 1, "package surface"),
    Rule("blast", "S836", "file", "lines > 500", 1, "files beyond 500 lines"),
    Rule("blast", "S854", "file", _like("stem", *[f"{w}%" for w in _TEST_STEMS]), 1, "test helpers"),
    Rule("blast", "S860", "file", _IN_API, 1, "files of interface folders"),
    Rule("blast", "S890", "file", f"{_has('stem', *_DATA_WORDS)} AND NOT {_has('stem', 'mock', 'test')}", 1, "database access"),
    Rule("blast", "S968", "file", f"{_has(_PATH, 'migrations/', 'migration/', 'alembic/')} OR " + _like("stem", *[p for w in ("migration", "migrate", "alembic", "schema", "flyway") for p in (w, f"{w}_%")]), 1, "database migration by folder or name"),
    Rule("blast", "S908", "file", "symbols >= 30", 1, "thirty symbols in a file"),
    Rule("blast", "S914", "file", "is_test", 1, "a test file is asked for"),
    Rule("blast", "S956", "file", f"base = 'conftest.py' OR {_like('stem', 'fixtures', 'conftest', 'conftest_%')}", 1, "shared test fixture"),
    Rule("hotspots", "S388", "top", _has(_PATH, "route", "endpoint", "view", "controller", "handler", "rest", "graphql", "api"), 1, "top hotspot serves requests"),
    Rule("hotspots", "S400", "top", "is_test", 1, "top hotspot in a test file"),
    Rule("hotspots", "S424", "top", f"{_SRC} AND kind = 'class' AND callers >= 3", 1, "top hotspot is a called class"),
    Rule("hotspots", "S430", "top", f"{_SRC} AND complexity >= 20", 1, "top hotspot is complex"),
    Rule("hotspots", "S436", "top", f"{_SRC} AND {_has(_PATH, *_TOP_DATA)}", 1, "top hotspot in the data layer"),
    Rule("hotspots", "S478", "top", f"{_SRC} AND {_has(_PATH, *_TOP_GENERATED)}", 1, "top hotspot in generated code"),
    Rule("hotspots", "S498", "top", f"{_SRC} AND " + _has(f"replace(replace({_PATH}, '_', ''), '-', '')", *_TOP_WRAPPERS), 1, "top hotspot wraps a dependency"),
    Rule("hotspots", "S550", "top", f"{_SRC} AND {_FN} AND {_PRIVATE}", 1, "top hotspot is private, yet called"),
    Rule("hotspots", "S568", "top", f"{_SRC} AND {_FOLDERS} >= 3", 1, "top hotspot three folders deep"),
    Rule("hotspots", "S574", "top", f"{_SRC} AND callers > 0 AND test_callers = callers", 1, "only tests call the top hotspot"),
    Rule("hotspots", "S580", "top", f"{_SRC} AND file_symbols >= 10", 1, "top hotspot in a wide file"),
    Rule("hotspots", "S591", "top", f"{_SRC} AND {_MIXED_CASE} = '__init__.py'", 1, "top hotspot in a package file"),
    Rule("hotspots", "S604", "top", "is_test", 1, "top hotspot belongs to a fixture"),
    Rule("hotspots", "S610", "top", f"{_SRC} AND right(file_path, 3) <> '.py'", 1, "top hotspot not in Python"),
    # the first hotspot, its callers and its callees
    *[
        Rule("hotspots", i, "top", f"{_SRC} AND {condition}", 1, label)
        for i, condition, label in [
            ("S510", f"{_FN} AND left(signature, 6) = 'async '", "top hotspot is asynchronous"),
            ("S850", f"{_FN} AND left(ltrim(signature), 6) = 'async '", "an asynchronous function leads"),
            ("S529", f"{_FN} AND lines > 50", "top hotspot is a long function"),
            ("S706", f"{_FN} AND byte_size > 3000", "top hotspot beyond 3000 bytes"),
            ("S585", f"{_FN} AND complexity < 3 AND callers >= 3", "top hotspot is simple"),
            ("S646", f"{_FN} AND complexity <= 1 AND callers >= 5", "top hotspot is trivial"),
            ("S664", f"{_FN} AND callers >= 5 AND callees = 0", "top hotspot calls nothing"),
            ("S712", f"{_FN} AND callers >= 1 AND callees > callers", "top hotspot calls more than it is called"),
            ("S778", "complexity >= 10", "top hotspot of complexity 10"),
            ("S622", "kind = 'class' AND member_fns >= 5", "top hotspot is a class with five methods"),
            ("S796", "kind = 'class' AND member_fns >= 10", "top hotspot is a class with ten methods"),
            ("S952", "kind = 'method' AND parent_id IS NOT NULL", "top hotspot is a method"),
            ("S676", "kind IN ('function', 'method', 'class') AND callers > 0 AND test_callers = callers", "tests alone call the top hotspot"),
            ("S790", "exported AND test_callers >= 3 AND test_callers = callers", "three tests and no source call the top hotspot"),
            ("S730", "callers > 0 AND test_callers = 0", "no test among the callers"),
            ("S838", "callers > 0 AND test_callers = 0", "callers, but no tests"),
            ("S922", "test_callers > 0", "tests call the top hotspot"),
            ("S736", "callers >= 5 AND callees >= 5", "choke point"),
            ("S754", "cross_callers = 1", "one caller from another file"),
            ("S784", "callers >= 4 AND outer_callers = 0", "called within its folder only"),
            ("S562", "far_roots >= 3", "called from three packages"),
            ("S742", "src_roots >= 3", "called from three top folders"),
            ("S814", "cross_roots >= 3", "called from three modules"),
            ("S976", "src_folders >= 3", "called from three folders"),
            ("S802", "callers >= 4 AND callees - self_calls = 1", "thin wrapper"),
            ("S832", "callers >= 3 AND cross_files = 1", "called from one other file"),
            ("S868", "callers >= 10", "ten callers"),
            ("S874", "caller_files >= 5", "five caller files"),
            ("S928", "lines <= 5 AND callers >= 5", "short and heavily called"),
            ("S958", "(right(file_path, 12) = '/__init__.py' OR file_path = '__init__.py')", "top hotspot at the beginning of a package"),
            ("S964", "src_files >= 10", "ten caller sources"),
            ("S982", "callers - test_callers >= 3 AND lines >= 50", "heavyweight"),
            ("S994", "callers > test_callers AND src_cross_callers = 0", "called within its file only"),
        ]
    ],
    Rule("hotspots", "S418", "top", _has(_PATH, "vendor/", "third_party/", "vendors/", "node_modules/", "external/"), 1, "top hotspot is vendored"),
    Rule("hotspots", "S820", "top", "is_test", 1, "a test leads"),
    Rule("hotspots", "S262", "leader", f"{_SRC} AND {_FN} AND test_callers >= 3", 1, "well-tested hotspots"),
    Rule("hotspots", "S826", "top", f"{_SRC} AND {_FN} AND lines >= 50", 1, "top hotspot has a long body"),
    Rule("hotspots", "S856", "top", _like("stem", *_TOP_LEGACY), 1, "top hotspot in a legacy file"),
    Rule("hotspots", "S880", "top", f"{_SRC} AND callers = 0", 1, "nothing is known to call the top hotspot"),
    Rule("hotspots", "S898", "top", f"{_SRC} AND lines >= 50", 1, "top hotspot of 50 lines"),
    Rule("hotspots", "S916", "top", f"{_SRC} AND callers = 1", 1, "top hotspot with one caller"),
    Rule("hotspots", "S934", "top", f"{_SRC} AND callers > 0 AND test_callers = 0", 1, "no test calls the top hotspot"),
    Rule("hotspots", "S946", "top", f"{_SRC} AND lines >= 100", 1, "top hotspot of 100 lines"),
    Rule("hotspots", "S970", "top", f"{_SRC} AND {_FN} AND exported", 1, "top hotspot is public"),
    Rule("hotspots", "S988", "top", f"{_SRC} AND {_FN} AND {_PRIVATE}", 1, "a private function leads"),
    Rule("hotspots", "S1000", "top", f"{_SRC} AND lines >= 150", 1, "top hotspot of 150 lines"),
    Rule("hotspots", "S1006", "top", f"{_SRC} AND {_like('base', *_TOP_ENTRIES)}", 1, "top hotspot at an entry point"),
    Rule("hotspots", "S1020", "top", f"{_SRC} AND file_functions = 1", 1, "top hotspot alone in its file"),
    *[_unused(i, p, n, label) for i, p, n, label in _DEAD],
    *[Rule("diff", i, "diff", _like("base", *p), n, label) for i, p, n, label in _DIFF],
    *[Rule("blast", i, "file", _like("base", *p), 1, label) for i, p, label in _BLAST],
    *[_unused(i, p, n, label) for i, n, label, p in _DEAD_MORE],
    *[_unused(i, p, n, label) for i, n, label, p in _DEAD_PREFIX],
    *[Rule("dead", i, "symbol", f"confidence IS NOT NULL AND {_SRC} AND {_FN}{' AND parent_id IS NULL' if outer else ''} AND {_like('low', *p)}", 1, label) for i, outer, label, p in _DEAD_ANY],
    *[Rule("dead", i, "symbol", f"{_SRC} AND kind = 'function' AND callers = 0 AND file_importers = 0 AND {_like('name', *p)}", 2, label) for i, label, p in _DEAD_ALONE],
    Rule("dead", "S635", "symbol", f"confidence IS NOT NULL AND {_SRC} AND {_has('lower(doc)', 'deprecated', 'obsolete', 'do not use', 'do_not_use', 'legacy')}", 1, "unused and documented as outdated"),
    Rule("dead", "S647", "symbol", f"confidence IS NOT NULL AND {_SRC} AND kind = 'class' AND {_has('low', 'mixin', 'base', 'abstract')}", 1, "unused bases"),
    Rule("dead", "S653", "symbol", f"confidence IS NOT NULL AND {_SRC} AND kind = 'class' AND {_has('name', 'Protocol', 'Interface', 'ABC', 'Abstract')} AND NOT {_has('name', 'Mixin', 'Base')}", 1, "unused protocols"),
    Rule("dead", "S719", "symbol", f"confidence IS NOT NULL AND {_SRC} AND {_FN} AND {_like('low', 'load_%', 'parse_%', 'read_%')} AND {_has('low', 'config', 'setting', 'conf', 'cfg')}", 1, "unused loaders of settings"),
    *[Rule("dead", i, "symbol", f"confidence {'>= 40' if i in _SURE else 'IS NOT NULL'} AND {_SRC} AND kind = 'class' AND {_like('low', *p)}", n, label) for i, n, label, p in _DEAD_CLASSES],
    *[Rule("diff", i, "diff", _like("base", *p), n, label) for i, n, label, p in _DIFF_MORE],
    Rule("dead", "S159", "symbol", "confidence IS NOT NULL AND kind IN ('constant', 'variable')", 3, "unused constants"),
    Rule("dead", "S178", "symbol", "confidence >= 40 AND exported AND callers = 0 AND kind IN ('function', 'method')", 3, "unused exported functions"),
    Rule("dead", "S279", "symbol", "confidence >= 40 AND signature LIKE 'async %'", 2, "unused async functions"),
    Rule("dead", "S665", "symbol", f"confidence IS NOT NULL AND {_SRC} AND {_FN} AND instr(signature, '->') > 0", 1, "unused annotated functions"),
    Rule("dead", "S76", "symbol", "NOT exported AND callers = 0 AND kind IN ('function', 'method') AND NOT is_test", 3, "private functions without callers"),
    Rule("dead", "S140", "symbol", f"confidence IS NOT NULL AND is_test AND {_FN}", 3, "unused helpers in test files"),
    Rule("dead", "S893", "symbol", f"confidence IS NOT NULL AND {_SRC} AND exported AND parent_id IS NULL AND kind IN ('function', 'class')", 1, "unused exports"),
    Rule("dead", "S98", "symbol", "confidence >= 40", 1, "removable with some confidence"),
    Rule("blast", "S207", "file", "importers = 1", 1, "files with a single importer"),
    Rule("blast", "S138", "file", "imports >= 5", 1, "aggregators"),
    Rule("blast", "S371", "file", "symbols >= 15 AND importers >= 5", 1, "utility belts"),
    Rule("blast", "S425", "file", "symbols > 0 AND constants = symbols AND importers >= 3", 1, "files of constants"),
    Rule("blast", "S490", "file", "max_cx >= 15", 1, "files with a complex function"),
    Rule("blast", "S692", "file", "importers >= 10", 1, "heavily imported files"),
    Rule("blast", "S782", "file", "is_test", 1, "test files"),
    Rule("blast", "S99", "symbol", "exported AND cross_files >= 3", 2, "exposed exports"),
    Rule("focus", "S168", "symbol", f"{_FN} AND lines >= 50", 1, "large functions"),
    Rule("focus", "S228", "symbol", "kind = 'class' AND subtypes > 0", 1, "classes with subclasses in focus"),
    Rule("focus", "S690", "symbol", f"kind = 'class' AND {_SRC} AND children >= 10", 1, "classes with many methods"),
    Rule("focus", "S666", "symbol", f"{_SRC} AND callees >= 5", 1, "high fan-out"),
    Rule("focus", "S750", "symbol", f"{_FN} AND {_SRC} AND doc = '' AND cross_files >= 3", 1, "widely called without a doc"),
    Rule("focus", "S816", "symbol", f"{_FN} AND parent_id IS NULL AND {_SRC} AND signature LIKE '%()%'", 1, "functions without parameters"),
    Rule("focus", "S870", "symbol", f"{_FN} AND {_SRC} AND callers = 0", 1, "functions without recorded callers"),
    Rule("focus", "S1014", "symbol", "kind IN ('function', 'method', 'test') AND (name LIKE 'test_%' OR is_test)", 1, "test functions"),
    Rule("focus", "S552", "symbol", "signature LIKE 'async %'", 1, "async functions"),
    Rule("focus", "S948", "symbol", "kind = 'class' AND children = 0", 1, "classes without methods"),
]
