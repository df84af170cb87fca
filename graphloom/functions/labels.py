"""Labels and scores of symbols, from fixed tables of names and patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns and weights that decide results.
NOISE_NAMES = ["GetMinLogLevel", "LogMessage", "LogMessageVoidify", "defaultCenter", "postNotificationName:object:", "StringPiece", "basic_stringstream", "NSLog", "c_str", "str", "stream"]
NOISE_PATTERN = "^operator(?:[^a-zA-Z]|$)"
MESSAGE_ROLES = [
    (r"^addObserver:", "notification_observer"),
    (r"^postNotificationName:", "notification_poster"),
    (r"^removeObserver:", "notification_observer"),
    (r"^addTarget:action:", "target_action"),
    (r"^sendAction:to:", "action_sender"),
    (r"^set\w*Delegate:$", "delegate_setter"),
    (r"^set\w*DataSource:$", "data_source"),
    (r"^viewDidLoad$", "framework_callback"),
    (r"^viewWillAppear:$", "framework_callback"),
    (r"^viewDidAppear:$", "framework_callback"),
    (r"^viewWillDisappear:$", "framework_callback"),
    (r"^viewDidDisappear:$", "framework_callback"),
    (r"^application:", "framework_callback"),
    (r"^scene:", "framework_callback"),
    (r"^windowScene:", "framework_callback"),
    (r"^tableView:numberOfRows", "framework_callback"),
    (r"^tableView:cellForRow", "framework_callback"),
    (r"^numberOfSectionsIn", "framework_callback"),
    (r"^collectionView:numberOfItems", "framework_callback"),
    (r"^collectionView:cellForItem", "framework_callback"),
    (r"^didReceiveMemoryWarning$", "framework_callback"),
    (r"^awakeFromNib$", "framework_callback"),
    (r"^prepareForSegue:sender:$", "framework_callback"),
    (r"^loadView$", "framework_callback"),
]
CALLBACK_PATTERNS = [
    r"^(application|userNotificationCenter):",
    r"^(scene|windowScene):",
    r"^(viewDidLoad|viewWillAppear|viewDidAppear|viewWillDisappear|viewDidDisappear|viewWillLayoutSubviews|viewDidLayoutSubviews|loadView|awakeFromNib|prepareForSegue:sender:|didReceiveMemoryWarning):?$",
    r"^(tableView:numberOfRows|tableView:cellForRow|tableView:numberOfSections|numberOfSectionsIn)",
    r"^(collectionView:numberOfItems|collectionView:cellForItem|numberOfSectionsIn)",
]
SDK_CALLBACKS = ["viewdidload", "viewwillappear", "viewdidappear", "viewwilldisappear", "viewdiddisappear", "application:", "scene:", "tableview:", "collectionview:"]
WORKER_TOKENS = ["process_msg", "worker", "thread", "dispatch", "queue", "async", "runloop"]
MAIN_THREAD_TOKENS = ["mainthread", "main_thread", "mainqueue", "main_queue", "dispatch_get_main_queue"]
LIFECYCLE_TOKENS = ["dealloc", "destroy", "dispose", "cleanup", "uninit", "tear_down", "teardown"]
SINK_TOKENS = ["notification", "notify", "observer", "callback", "selector"]
LAYERS = [
    ("ui", ["ui", "view", "screen", "widget", "component", "panel"]),
    ("data", ["data", "repository", "store", "database", "db", "persistence", "storage"]),
    ("service", ["service", "api", "network", "manager", "logic", "business", "interactor"]),
]
VIOLATIONS = [("ui", "data", "UI→Data"), ("data", "service", "Data→Service")]
KIND_PRIORITY = {"class": 5, "struct": 4, "enum": 4, "protocol": 4, "interface": 4, "function": 3, "method": 2, "constructor": 1}
ENTRY_BOOSTS = [
    (r"^(application|scene|userNotificationCenter):", 3.0),
    (r"^(handle|Handle|didReceive|onReceive)", 2.5),
    (r"^(imCmd|confNoti|notify|onConf|call)", 2.0),
    (r"^(viewDid|onLogin|onStart|pushNoti|report)", 1.5),
]
ENTRY_PENALTIES = [
    r"^(getter:|setter:|dealloc|\.cxx_destruct|init$|initWith)",
    r"^(tableView:|collectionView:|numberOfSections|numberOfRows)",
    r"^(itemsWith|actionsWith|onRender|onMoreMenu|loadSubviews?$)",
    r"^(refreshUI|find_by_|dispatchJSEvent|getCallOut)",
]
KIND_GROUPS = [
    (["struct", "class", "enum", "protocol", "extension", "union"], None),
    (["function", "constructor", "destructor"], "function"),
    (["instancemethod", "staticmethod", "classmethod"], "method"),
    (["instanceproperty", "staticproperty", "classproperty"], "instanceProperty"),
    (["var", "variable", "local", "parameter"], "var"),
]
TYPE_KINDS = ["class", "struct", "enum", "protocol"]
DIRECT, INFERRED = "source_direct", "indexstore_relation_only"


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def has_any(text: Column, tokens: list[str]) -> Column:
    return any_of([text.contains(t) for t in tokens])


def is_noise(name: Column) -> Column:
    """Overloaded operators and helpers of logging and streams; a null name is none."""
    return F.coalesce(name.isin(NOISE_NAMES) | name.rlike(NOISE_PATTERN), F.lit(False))


def confidence_of(reason: Column) -> Column:
    return F.when(reason == INFERRED, "inferred").otherwise("compiler-verified")


def is_framework_callback(name: Column) -> Column:
    return F.coalesce(any_of([name.rlike(p) for p in CALLBACK_PATTERNS]), F.lit(False))


def message_role(selector: Column) -> Column:
    """First role whose pattern fits the selector, else unknown."""
    return F.coalesce(*[F.when(selector.rlike(p), role) for p, role in MESSAGE_ROLES], F.lit("unknown"))


def execution_boundary(name: Column, kind: Column, role: Column) -> Column:
    """struct(role, confidence, reason) of the first boundary that a symbol looks like, else null."""
    n, k, r = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, kind, role))
    tests = [
        (r == "notification_observer", "notification_callback_sink", "objc notification observer call"),
        ((r == "framework_callback") | k.contains("callback") | has_any(n, SDK_CALLBACKS), "sdk_callback", "framework callback-shaped symbol"),
        (has_any(n, WORKER_TOKENS), "worker_thread_dispatch", "worker/thread dispatch-shaped symbol"),
        (has_any(n, MAIN_THREAD_TOKENS), "main_thread_task", "main-thread dispatch-shaped symbol"),
        (has_any(n, LIFECYCLE_TOKENS) | n.startswith("~"), "lifecycle_uninit_path", "lifecycle teardown-shaped symbol"),
        (has_any(n, SINK_TOKENS), "notification_callback_sink", "callback/notification-shaped symbol"),
    ]
    return F.coalesce(*[F.when(t, F.struct(F.lit(a).alias("role"), F.lit("heuristic").alias("confidence"), F.lit(b).alias("reason"))) for t, a, b in tests])


def source_scope(path: Column, root: str) -> Column:
    """Whether a path lies under the workspace root; both are taken as normalised absolute paths."""
    root = root.rstrip("/")
    inside = (path == root) | path.startswith(root + "/")
    return F.when(path.isNull() | (path == ""), "unknown").when(inside, "inside_workspace_root").otherwise("outside_workspace_root")


def module_layer(module: Column) -> Column:
    """Layer by the first substring that fits the lower-cased name."""
    low = F.lower(module)
    return F.coalesce(*[F.when(has_any(low, tokens), layer) for layer, tokens in LAYERS], F.lit("unknown"))


def layer_violation(caller_module: Column, callee_module: Column) -> Column:
    a, b = module_layer(caller_module), module_layer(callee_module)
    return F.coalesce(*[F.when((a == x) & (b == y), label) for x, y, label in VIOLATIONS])


def query_kind(raw: Column) -> Column:
    call = raw.contains("::") & raw.contains("(") & raw.contains(")")
    return F.when(call, "frame").when(raw.contains("::"), "qualified_symbol").otherwise("symbol")


def candidate_score(kind: Column, file_path: Column, module: Column, file_hint: str = "", kind_hint: str = "", module_hint: str = "") -> Column:
    """Score of a name match in 0..1: 0.5, more for hints that hold or, without a kind hint, for likely kinds."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    score = F.lit(0.50)
    if file_hint:
        score = score + F.when(low(file_path).contains(file_hint.lower()), 0.40).otherwise(0.0)
    if kind_hint:
        score = score + F.when(low(kind) == kind_hint.lower(), 0.20).otherwise(0.0)
    if module_hint:
        score = score + F.when(low(module) == module_hint.lower(), 0.10).otherwise(0.0)
    if not kind_hint:
        score = score + F.coalesce(*[F.when(low(kind) == k, F.lit(p * 0.02)) for k, p in KIND_PRIORITY.items()], F.lit(0.0))
    return F.round(F.least(F.lit(1.0), score), 2)


def entry_score(name: Column, callees: Column, callers: Column) -> Column:
    """Fan-out over fan-in, halved for utility names, times the highest boost of the name."""
    n = F.coalesce(name, F.lit(""))
    penalty = F.when(any_of([n.rlike(p) for p in ENTRY_PENALTIES]), 0.5).otherwise(1.0)
    boost = F.greatest(F.lit(1.0), *[F.when(n.rlike(p), w).otherwise(1.0) for p, w in ENTRY_BOOSTS])
    return callees / (callers + 1) * penalty * boost


def risk_level(direct: Column, has_bridge: Column, fresh: Column) -> Column:
    return F.when(~fresh, "critical").when((direct >= 10) | (has_bridge & (direct >= 4)), "high").when(direct >= 4, "medium").otherwise("low")


def symbol_kind(kind: Column) -> Column:
    """Scanner kinds to symbol kinds; unknown ones pass through in lower case."""
    low = F.lower(kind)
    return F.coalesce(*[F.when(low.isin(group), low if to is None else F.lit(to)) for group, to in KIND_GROUPS], low)


def process_id(entry_usr: Column) -> Column:
    return F.concat(F.lit("proc_"), F.substring(F.md5(entry_usr), 1, 12))


def build_id(*parts: Column) -> Column:
    return F.concat(F.lit("build-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def primary_surface(module: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (module, name, kind)])


#: Words of the names round a change, and the tests that they call for (fixed values).
TEST_HINTS = [
    (["audio", "mic", "speaker", "device"], "audio device add/remove and default-device change"),
    (["start", "stop", "restart"], "start/stop/restart flow"),
    (["config", "setting", "preference"], "configuration change flow"),
    (["bridge", "objc", "swift"], "cross-language bridge caller"),
]


def likely_tests(terms: Column) -> Column:
    low = F.lower(terms)
    return F.array_compact(F.array(F.lit("direct caller smoke test"), *[F.when(has_any(low, words), hint) for words, hint in TEST_HINTS]))


def chunk_kind(kind: Column) -> Column:
    return F.when(kind.isin(*TYPE_KINDS), "type").otherwise("method")


def chunk_text(kind: Column, name: Column, signature: Column) -> Column:
    head = F.concat(F.coalesce(kind, F.lit("")), F.lit(" "), F.coalesce(name, F.lit("")))
    return F.when(F.coalesce(signature, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(": "), signature))


def full_match(text: Column, raw: str) -> Column:
    """Search pattern over the whole text: a raw word matches anywhere, a regular expression as it stands."""
    import re

    pattern = raw if re.search(r"[.^$*+?{}\[\]|()\\]", raw) else f".*{raw}.*"
    re.compile(pattern)  # an invalid pattern raises here, not on an executor
    return text.rlike(f"^(?:{pattern})$")


def freshness(found_toolchain: Column, found_hash: Column, toolchain: str | None = None, build_hash: str | None = None, row_found: Column | None = None) -> Column:
    """stale without a snapshot, else which of toolchain and configuration differ from those given, else fresh."""
    out = F.when(~row_found if row_found is not None else found_toolchain.isNull(), "stale")
    if toolchain:
        out = out.when(found_toolchain != toolchain, "toolchain_mismatch")
    if build_hash:
        out = out.when(found_hash != build_hash, "build_mismatch")
    return out.otherwise("fresh")


def search_freshness(status: Column) -> Column:
    return F.when(status == "fresh", "fresh").when(status == "stale", "stale").when(status.isin("toolchain_mismatch", "build_mismatch"), "partially_stale").otherwise("unknown")
