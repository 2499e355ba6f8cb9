"""Small families of functions with a known verdict: (family, file, language, text)."""

_PLAIN = """export function pack{0}(rows: Row[]): string {{
  const out: string[] = [];
  for (const r of rows) {{
    out.push(r.id + ":" + r.value);
  }}
  return out.join(",");
}}
"""
_SORTED = """export function packC(rows: Row[]): string {
  const out: string[] = [];
  for (const r of rows) {
    out.push(r.id + ":" + r.value);
  }
  out.sort();
  return out.join(",");
}
"""
_LOGGED = """export function packD(rows: Row[]): string {
  const out: string[] = [];
  for (const r of rows) {
    out.push(r.id + ":" + r.value);
  }
  log(rows);
  return out.join(",");
}
"""
_PY = """def total_{0}(rows):
    out = 0
    for r in rows:
        out = out + r.value
    return out
"""
_PY_GUARD = """def total_c(rows):
    out = 0
    if not rows:
        return None
    for r in rows:
        out = out + r.value
    return out
"""
CODE = [
    ("same", "a/one.ts", "ts", _PLAIN.format("A")),
    ("same", "a/two.ts", "ts", _PLAIN.format("B")),
    ("on-path", "b/one.ts", "ts", _PLAIN.format("A")),
    ("on-path", "b/two.ts", "ts", _PLAIN.format("B")),
    ("on-path", "b/three.ts", "ts", _SORTED),
    ("off-path", "c/one.ts", "ts", _PLAIN.format("A")),
    ("off-path", "c/two.ts", "ts", _PLAIN.format("B")),
    ("off-path", "c/four.ts", "ts", _LOGGED),
    ("label", "d/one.ts", "ts", _PLAIN.format("A")),
    ("label", "d/two.ts", "ts", _PLAIN.format("B").replace(".join", ".concat")),
    ("label", "d/three.ts", "ts", _PLAIN.format("C")),
    ("guard", "e/a.py", "py", _PY.format("a")),
    ("guard", "e/b.py", "py", _PY.format("b")),
    ("guard", "e/c.py", "py", _PY_GUARD),
]
_C = "int clamp_{0}(int v) {{\n  if (v > {1}) return {1};\n  return v;\n}}\n"
_JAVA = "class J{0} {{\n  int size{0}(int[] xs) {{\n    int n = 0;\n    for (int x : xs) {{ n = n + x; }}\n{1}    return n;\n  }}\n}}\n"
_CPP = "int sum_{0}(int a, int b) {{\n  int sum = a + b;\n{1}  return sum;\n}}\n"
_PHP = "<?php\nfunction name_{0}($a) {{\n{1}  $b = trim($a);\n  return $b;\n}}\n"
_SCALA = "object O{0} {{\n  def twice{0}(x: Int): Int = {{\n    val z = x + x\n    z\n  }}\n}}\n"
CODE += [
    ("literal", "f/a.c", "c", _C.format("a", 10)),
    ("literal", "f/b.c", "c", _C.format("b", 10)),
    ("literal", "f/c.c", "c", _C.format("c", 12)),
    ("audit", "g/A.java", "java", _JAVA.format("A", "")),
    ("audit", "g/B.java", "java", _JAVA.format("B", "")),
    ("audit", "g/C.java", "java", _JAVA.format("C", "    audit(xs);\n")),
    ("loop", "h/a.cpp", "cpp", _CPP.format("a", "")),
    ("loop", "h/b.cpp", "cpp", _CPP.format("b", "")),
    ("loop", "h/c.cpp", "cpp", _CPP.format("c", "  for (int i = 0; i < 2; i++) { sum = sum + i; }\n")),
    ("php-guard", "i/a.php", "php", _PHP.format("a", "")),
    ("php-guard", "i/b.php", "php", _PHP.format("b", "")),
    ("php-guard", "i/c.php", "php", _PHP.format("c", "  if (!$a) { return null; }\n")),
    ("scala", "j/A.scala", "scala", _SCALA.format("A")),
    ("scala", "j/B.scala", "scala", _SCALA.format("B")),
]

_FLAGGED, _OFF = "introduces {0} that its twins lack, on the critical path ({1})", "introduces {0}, but off the path to the return value (the insertion defines nothing and changes no returned value)"
#: family, n_units, verdict, confidence, shape, summary, as they follow from the norm.
VERDICTS_OF_CODE = [
    ("same", 2, "ignore", 0.95, "none", "equal structure and labels"),
    ("on-path", 3, "flag", 0.85, "extra-call", _FLAGGED.format("CALL", "the insertion changes a returned value")),
    ("off-path", 3, "escalate", 0.45, "extra-call", _OFF.format("CALL")),
    ("label", 3, "escalate", 0.4, "label-divergence", "equal structure, other labels: IDENT_CALLEE 'join' vs 'concat'"),
    ("guard", 3, "flag", 0.85, "extra-branch", _FLAGGED.format("BRANCH", "the insertion holds a return")),
    ("literal", 3, "escalate", 0.4, "label-divergence", "equal structure, other labels: LITERAL_NUM '10' vs '12'; LITERAL_NUM '10' vs '12'"),
    ("audit", 3, "escalate", 0.45, "extra-call", _OFF.format("CALL")),
    ("loop", 3, "flag", 0.85, "extra-loop", _FLAGGED.format("LOOP", "defined labels reach the return value: i, sum")),
    ("php-guard", 3, "flag", 0.85, "extra-branch", _FLAGGED.format("BRANCH", "the insertion holds a return")),
    ("scala", 2, "ignore", 0.95, "none", "equal structure and labels"),
]
#: file, label: what the functions call. Only ts/js tells callees from other names.
CALLS_OF_CODE = [(p, x) for _, p, lang, text in CODE if lang == "ts" for x in ("push", "join", "concat", "sort", "log") if f"{x}(" in text]
_EACH = "LOOP(DECL(IDENT_VAR) IDENT_PARAM BLOCK(CALL(MEMBER(IDENT_VAR IDENT_CALLEE) BINARY(BINARY(MEMBER(IDENT_VAR IDENT_PROP) LITERAL_STR) MEMBER(IDENT_VAR IDENT_PROP)))))"
_PACK = "FUNCTION(PARAM(IDENT_PARAM) BLOCK(DECL(IDENT_VAR ARRAY) " + _EACH + "{0} RETURN(CALL(MEMBER(IDENT_VAR IDENT_CALLEE) LITERAL_STR))))"
_TOTAL = "FUNCTION(IDENT_VAR BLOCK(ASSIGN(IDENT_VAR LITERAL_NUM){0} LOOP(IDENT_VAR IDENT_VAR BLOCK(ASSIGN(IDENT_VAR BINARY(IDENT_VAR MEMBER(IDENT_VAR IDENT_VAR))))) RETURN(IDENT_VAR)))"
_SIZE = "FUNCTION(PARAM(IDENT_VAR) BLOCK(DECL(DECL(IDENT_VAR LITERAL_NUM)) LOOP(IDENT_VAR IDENT_VAR BLOCK(ASSIGN(IDENT_VAR BINARY(IDENT_VAR IDENT_VAR)))){0} RETURN(IDENT_VAR)))"
_SUM = "FUNCTION(PARAM(IDENT_VAR) PARAM(IDENT_VAR) BLOCK(DECL(DECL(IDENT_VAR BINARY(IDENT_VAR IDENT_VAR))){0} RETURN(IDENT_VAR)))"
_COUNTING = " LOOP(DECL(DECL(IDENT_VAR LITERAL_NUM)) BINARY(IDENT_VAR LITERAL_NUM) UNARY(IDENT_VAR) BLOCK(ASSIGN(IDENT_VAR BINARY(IDENT_VAR IDENT_VAR))))"
_NAME = "FUNCTION(PARAM(IDENT_VAR) BLOCK({0}ASSIGN(IDENT_VAR CALL(IDENT_VAR)) RETURN(IDENT_VAR)))"
#: Trees of the functions by their first letters and the file's place in its family, as they follow from the sources.
TREES_OF_CODE = {
    "pack": _PACK.format(""), "b/three.ts": _PACK.format(" CALL(MEMBER(IDENT_VAR IDENT_CALLEE))"), "c/four.ts": _PACK.format(" CALL(IDENT_CALLEE IDENT_PARAM)"),
    "total": _TOTAL.format(""), "e/c.py": _TOTAL.format(" BRANCH(UNARY(IDENT_VAR) BLOCK(RETURN(LITERAL_OTHER)))"),
    "clamp": "FUNCTION(PARAM(IDENT_VAR) BLOCK(BRANCH(BINARY(IDENT_VAR LITERAL_NUM) RETURN(LITERAL_NUM)) RETURN(IDENT_VAR)))",
    "size": _SIZE.format(""), "g/C.java": _SIZE.format(" CALL(IDENT_VAR OTHER(IDENT_VAR))"), "sum": _SUM.format(""), "h/c.cpp": _SUM.format(_COUNTING),
    "name": _NAME.format(""), "i/c.php": _NAME.format("BRANCH(UNARY(IDENT_VAR) BLOCK(RETURN(LITERAL_OTHER))) "),
    "twice": "FUNCTION(PARAM(IDENT_VAR) BLOCK(DECL(IDENT_VAR BINARY(IDENT_VAR IDENT_VAR)) IDENT_VAR))",
}


def nodes_of_code() -> list[tuple[str, int, int, str]]:
    """file, pre-order number, depth, kind of each node of each example."""
    import re

    out = []
    for _, path, _, text in CODE:
        tree = TREES_OF_CODE.get(path) or next(t for k, t in TREES_OF_CODE.items() if re.search(rf"\b{k}(_|[A-Z])", text))
        depth = pre = 0
        for token in re.findall(r"\w+|[()]", tree):
            if token in "()":
                depth += 1 if token == "(" else -1
            else:
                out.append((path, pre, depth, token))
                pre += 1
    return out
