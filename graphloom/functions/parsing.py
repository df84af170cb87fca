"""Names, frames and source lines taken apart by regular expressions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of selectors, notifications, frames and cross-language names.
SELECTOR = r"@selector\(\s*([\w:]+)\s*\)"
NOTIFICATION_NAME = r"name:\s*(\S+)"
POST_NAME = r"postNotificationName:\s*(\S+)"
FOR_NAME = r"addObserverForName:\s*(\S+)"
CONTROL_EVENT = r"forControlEvents:\s*([A-Za-z0-9_]+)"
METHOD_LINE = r"^\s*[+-]\s*\([^)]*\)\s*(.+?)\s*(?:\{|$)"
SOURCE = r"(?:\s+\(([^:)]+)(?::(\d+))?\))?"
CXX_FRAME = r"([A-Za-z_~][\w:~<>$]*::[A-Za-z_~][\w:~<>$]*)\(([^)]*)\)" + SOURCE
OBJC_FRAME = r"([-+]\[([A-Za-z_][\w.$]*)(?:\([^)]+\))?\s+([A-Za-z_][\w:]*:?)\])(?:\s+\+\s+\d+)?" + SOURCE
SWIFT_FRAME = r"([A-Za-z_]\w*\.([A-Za-z_]\w*)\.([A-Za-z_~][\w~]*(?:\([^)]*\))?))(?:\s+\+\s+\d+)?" + SOURCE
OBJC_USR = r"^c:objc\(cs\)(.+?)\((im|cm)\)(.+)$"
SWIFT_USR = r"^s:([A-Za-z_][A-Za-z0-9_]*)[CVEO]\d+([A-Za-z_][A-Za-z0-9_]*)"
DECLARATION = r"(?:public |private |internal |open |@\w+(?:\([^)]*\))? )*(struct|class|enum|extension|protocol)\s+(\w+)\s*(?::\s*([^{]+?))?\s*\{"
NOT_PROTOCOLS = ["Int", "UInt", "String", "Double", "Float", "Bool", "Void", "Int8", "Int16", "Int32", "Int64", "UInt8", "UInt16", "UInt32", "UInt64", "NSObject", "UIViewController", "UIView", "UIResponder", "NSDate", "NSArray", "NSDictionary", "NSSet", "NSData", "NSMutableArray", "NSMutableDictionary", "NSMutableSet", "NSMutableData", "NSMutableString"]


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null where there is none or it took no part."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def clean_name(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), r"[\];]+$", "")


def observer_line(line: Column) -> Column:
    """struct(selector, name) of a line that adds an observer, else null; a block form has no selector."""
    named = F.struct(group(line, SELECTOR).alias("selector"), clean_name(group(line, NOTIFICATION_NAME)).alias("name"))
    block = F.struct(F.lit(None).cast("string").alias("selector"), clean_name(group(line, FOR_NAME)).alias("name"))
    adds = line.contains("addObserver")
    return F.when(adds & line.rlike(NOTIFICATION_NAME), named).when(adds & line.rlike(FOR_NAME), block)


def post_line(line: Column) -> Column:
    """Name of the notification that a line posts, else null."""
    return F.when(line.contains("postNotificationName"), clean_name(F.coalesce(group(line, POST_NAME), group(line, NOTIFICATION_NAME))))


def target_action_line(line: Column) -> Column:
    """struct(selector, control_event) of a line that wires a control; both null elsewhere."""
    adds = line.contains("addTarget")
    return F.struct(F.when(adds, group(line, SELECTOR)).alias("selector"), F.when(adds, group(line, CONTROL_EVENT)).alias("control_event"))


def method_selector(signature: Column) -> Column:
    """Selector of a method's first line: its labels joined, or its bare name."""
    body = group(signature, METHOD_LINE)
    labels = F.regexp_extract_all(body, F.lit(r"([A-Za-z_]\w*)\s*:"), F.lit(1))
    return F.when(F.size(labels) > 0, F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit(":"))), "")).otherwise(group(body, r"^([A-Za-z_]\w*)"))


def frame(raw: Column) -> Column:
    """struct(qualified_name, owner, symbol, signature, language_hint, source_file, source_line) of a stack
    frame: C++, then bracketed, then dotted form; null for several lines or none of these."""
    line = F.trim(raw)
    several = F.size(F.filter(F.split(raw, r"\r?\n"), lambda x: F.trim(x) != "")) > 1
    parts = F.split(group(line, CXX_FRAME), "::")
    cxx = [group(line, CXX_FRAME), F.element_at(parts, -2), F.element_at(parts, -1), F.regexp_extract(line, CXX_FRAME, 2), F.lit(None).cast("string"), group(line, CXX_FRAME, 3), group(line, CXX_FRAME, 4)]
    dotted = lambda p, hint, owner: [group(line, p), owner, group(line, p, 3), F.lit(""), F.lit(hint), group(line, p, 4), group(line, p, 5)]
    objc = dotted(OBJC_FRAME, "objc", F.element_at(F.split(group(line, OBJC_FRAME, 2), r"\."), -1))
    swift = dotted(SWIFT_FRAME, "swift", group(line, SWIFT_FRAME, 2))
    names = ["qualified_name", "owner", "symbol", "signature", "language_hint", "source_file", "source_line"]
    made = [F.struct(*[c.alias(n) for c, n in zip(cols, names)]) for cols in (cxx, objc, swift)]
    tests = [line.rlike(p) for p in (CXX_FRAME, OBJC_FRAME, SWIFT_FRAME)]
    return F.when(several, None).when(tests[0], made[0]).when(tests[1], made[1]).when(tests[2], made[2])


def expected_owners(parsed: Column) -> Column:
    """Ids that the owner named by a parsed frame may have."""
    owner, hint = parsed["owner"], parsed["language_hint"]
    dots, scopes = F.split(parsed["qualified_name"], r"\."), F.split(parsed["qualified_name"], "::")
    spaces = F.array_join(F.transform(F.slice(scopes, 1, F.greatest(F.size(scopes) - 2, F.lit(0))), lambda x: F.concat(F.lit("@N@"), x)), "")
    none = F.array().cast("array<string>")
    return (
        F.when(hint == "objc", F.array(F.concat(F.lit("c:objc(cs)"), owner)))
        .when(hint == "swift", F.when(F.size(dots) >= 3, F.array(F.concat(F.lit("s:"), dots[0], F.lit("."), owner), F.concat(F.lit("s:"), owner))).otherwise(none))
        .when(F.size(scopes) >= 3, F.array(F.concat(F.lit("c:"), spaces, F.lit("@S@"), owner)))
        .otherwise(none)
    )


def underscore_arity(arity: Column) -> Column:
    return F.when(arity <= 0, "()").otherwise(F.concat(F.lit("("), F.repeat(F.lit("_:"), arity), F.lit(")")))


def selector_base(selector: Column) -> Column:
    return F.regexp_replace(F.split_part(selector, F.lit(":"), F.lit(1)), r"With[A-Z].*$", "")


def signature_arity(signature: Column) -> Column:
    inner = F.trim(F.regexp_extract(F.coalesce(signature, F.lit("")), r"\((.*)\)", 1))
    return F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(","), F.lit(""))) + 1)


def objc_names(usr: Column) -> Column:
    """struct(container, clang_name, swift_name, arity) of an Objective-C method id, else nulls."""
    box, scope, selector = (group(usr, OBJC_USR, i) for i in (1, 2, 3))
    arity = F.length(selector) - F.length(F.replace(selector, F.lit(":"), F.lit("")))
    clang = F.concat(F.when(scope == "im", "-").otherwise("+"), F.lit("["), box, F.lit(" "), selector, F.lit("]"))
    swift = F.concat(box, F.lit("."), selector_base(selector), underscore_arity(arity))
    return F.struct(box.alias("container"), clang.alias("clang_name"), swift.alias("swift_name"), arity.alias("arity"), selector_base(selector).alias("member"))


def swift_names(usr: Column, name: Column, display: Column, signature: Column, kind: Column) -> Column:
    """struct(container, member, arity, swift_name) of a Swift symbol, from its display name, else its id."""
    shown = F.coalesce(display, F.lit(""))
    dotted, called = shown.contains("."), shown.contains("(") & shown.contains(")")
    from_shown = F.when(dotted, F.nullif(F.split_part(shown, F.lit("."), F.lit(1)), F.lit("")))
    after = F.when(dotted, F.regexp_replace(shown, r"^[^.]*\.", "")).otherwise(shown)
    shown_member = F.nullif(F.split_part(after, F.lit("("), F.lit(1)), F.lit(""))
    container = F.coalesce(from_shown, group(usr, SWIFT_USR, 1))
    member = F.when(from_shown.isNull() & usr.rlike(SWIFT_USR), group(usr, SWIFT_USR, 2)).otherwise(F.coalesce(shown_member, name))
    callable_ = kind.isin("method", "function")
    params = F.split_part(F.element_at(F.split(shown, r"\("), -1), F.lit(")"), F.lit(1))
    arity = F.when(called, (F.length(params) - F.length(F.replace(params, F.lit("_:"), F.lit("")))) / 2).when(callable_, signature_arity(signature)).otherwise(0).cast("int")
    owner = F.coalesce(F.concat(container, F.lit(".")), F.lit(""))
    full = F.when(shown.contains("(") & dotted, shown).when(callable_, F.concat(owner, member, underscore_arity(arity))).otherwise(F.concat(owner, member))
    return F.struct(container.alias("container"), member.alias("member"), arity.alias("arity"), full.alias("swift_name"))


def kind_group(kind: Column) -> Column:
    return F.when(kind.isin("method", "function"), "callable").otherwise(kind)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/[^/]*$", "")


def protocols(inherits: Column) -> Column:
    """Array of the protocols of an inheritance list: no generics, clauses, module prefixes or raw types."""
    bare = F.transform(F.split(inherits, ","), lambda p: F.element_at(F.split(F.trim(F.split(F.split(F.trim(p), "<")[0], " where")[0]), r"\."), -1))
    return F.filter(bare, lambda p: (p != "") & ~p.isin(NOT_PROTOCOLS))
