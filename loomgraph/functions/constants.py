"""Word lists, preferences, weights and patterns that results depend on."""

CALLABLE_TYPES = ("method", "function", "constructor", "hook", "component", "function_declaration", "macro")
TYPE_LIKE_TYPES = ("class", "interface", "struct", "component", "enum", "record")
DATA_TYPES = ("field", "global", "constant", "enum_constant")
SKIP_DIRS = (".git", ".mypy_cache", ".pytest_cache", ".venv", "__pycache__", "build", "dist", "node_modules", "site-packages", "venv")
LANGUAGES = {".java": "java", ".c": "c", ".h": "c", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript"}
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "did", "do", "does", "for", "from", "get", "give",
    "how", "i", "if", "in", "into", "is", "it", "me", "my", "of", "on", "or", "please", "show", "so", "tell", "than",
    "that", "the", "their", "them", "then", "there", "these", "this", "to", "up", "use", "used", "was", "what",
    "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)
FILE_EXTENSIONS = ("java", "py", "js", "jsx", "mjs", "c", "h", "ts", "tsx", "json", "md", "txt", "html", "css", "yml", "yaml")
SOURCE_SUFFIXES = (".py", ".java", ".c", ".h", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".json", ".md", ".txt", ".html", ".css", ".yml", ".yaml")
ROLE_WORDS = {
    "hook": "hook", "component": "component", "class": "class", "interface": "interface", "method": "method",
    "function": "function", "func": "function", "function_declaration": "function", "constructor": "constructor",
    "macro": "macro", "struct": "struct", "union": "union", "enum": "enum", "typedef": "typedef",
    "field": "field", "attribute": "field", "property": "field", "member": "field", "constant": "constant", "global": "global",
}
ROLE_EXPAND = {
    "function": ("function", "function_declaration"),
    "method": ("method", "function"),
    "component": ("component",),
    "field": ("field", "global", "constant"),
}
TYPE_WEIGHTS = {
    "method": 1.0, "function": 1.0, "constructor": 0.95, "hook": 1.0, "component": 0.95, "class": 0.9, "interface": 0.9,
    "struct": 0.8, "union": 0.8, "enum": 0.7, "record": 0.9, "macro": 0.6, "function_declaration": 0.55, "typedef": 0.5,
    "field": 0.45, "global": 0.45, "constant": 0.45, "enum_constant": 0.4,
}
DEFAULT_TYPE_WEIGHT = 0.7
HINT_BOOST = 2.0
MIN_EXACT_NAME = 3
LEXICAL_STRONG, LEXICAL_MIN, LEXICAL_RELATIVE = 3.0, 0.8, 0.35
BM25_K1, BM25_B, RETRIEVAL_B = 1.5, 0.75, 0.4
EXPAND_PREFIX, EXPAND_TERMS = 4, 4
MAX_CONTEXT_NODES = 5
MAX_HOPS = 12
EDGES_PER_NODE = 12
PREAMBLES = ("Here's a thinking process:", "Here is a thinking process:", "Let me think", "We need to answer")
TYPE_STYLE = {
    "class": ("box", "#e8f0fe"), "interface": ("box", "#e8f0fe"), "record": ("box", "#e8f0fe"), "enum": ("box", "#e8f0fe"),
    "struct": ("box", "#e8f0fe"), "union": ("box", "#e8f0fe"), "component": ("box", "#e6f4ea"), "hook": ("ellipse", "#e6f4ea"),
    "method": ("ellipse", "#ffffff"), "function": ("ellipse", "#ffffff"), "constructor": ("ellipse", "#fff7e0"),
    "function_declaration": ("note", "#f5f5f5"), "macro": ("hexagon", "#fce8e6"), "typedef": ("note", "#f5f5f5"),
    "field": ("plaintext", "#ffffff"), "global": ("plaintext", "#ffffff"), "constant": ("plaintext", "#ffffff"), "file": ("folder", "#f1f3f4"),
}
EDGE_STYLE = {"internal": ("solid", "#1a73e8"), "local": ("dashed", "#188038"), "external": ("dotted", "#9aa0a6")}
SEVERITIES = {"error": 2, "warning": 1}
HOC_WRAPPERS = (
    "useCallback", "useMemo", "memo", "forwardRef", "useEvent", "React.memo", "React.forwardRef", "React.useCallback",
    "React.useMemo", "observer", "withRouter", "connect",
)
SCHEMA_VERSION = 2

# Texts and forms of output that results are compared with: fixed values.
NO_FILE = "[source file not found]"
NO_LINES = "[line range out of bounds]"
RENAMED = ("The answer uses none of the real names it was given (e.g. `", "`), so it may have renamed or substituted the symbol.")
CITED = "The answer cites `"
OTHER_FILE = "`, but that file was not part of the facts provided."
OTHER_LINES = "`, which is not one of the real graph ranges — likely a subdivided or invented location."
INVENTED = ("The answer mentions `", "`, which does not exist in the knowledge graph under that name.")
DOT_NODE = '  "%s" [label="%s", shape=%s, style="filled,rounded", fillcolor="%s", color="%s", penwidth=%s, fontname="Helvetica", fontsize=10];'
DOT_EDGE = '  "%s" -> "%s" [label="%s", style=%s, color="%s", fontcolor="%s"];'
DOT_HEAD = 'digraph G {\n  rankdir=TB;\n  bgcolor="transparent";\n  node [margin="0.12,0.06"];\n  edge [fontname="Helvetica", fontsize=8, arrowsize=0.7];\n'
