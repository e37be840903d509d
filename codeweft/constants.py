"""These must be exactly as they are for results to agree."""

MODEL_NAME = "jinaai/jina-embeddings-v2-base-code"
SCHEMA_VERSION = "1"
FOREST_FORMAT = "lgbm-forest-v1"

# chunking
MAX_CHUNK_LINES = 250
MAX_CHUNK_BYTES = 8000
EMBED_MAX_CHARS = 2000
WINDOW_LINES = 80
WINDOW_OVERLAP = 15

# file selection
EXCLUDED_DIRS = [
    "node_modules", ".git", "target", "dist", "build", "out", "vendor",
    "third_party", ".next", ".nuxt", "coverage", "__pycache__", ".gradle",
    "Pods", ".venv", "venv", "generated",
]
LANG_BY_EXT = {
    ".rs": "rust", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".jsx": "tsx", ".py": "python", ".go": "go", ".kt": "kotlin", ".kts": "kotlin",
    ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".vue": "vue", ".md": "markdown",
    ".toml": "toml", ".yml": "yaml", ".yaml": "yaml", ".sql": "sql",
    ".sh": "bash", ".proto": "proto", ".graphql": "graphql",
}

# syntax node types that become chunks, per language
CAPTURE = {
    "rust": ["function_item", "struct_item", "enum_item", "trait_item", "impl_item",
             "macro_definition", "mod_item"],
    "python": ["function_definition", "class_definition", "decorated_definition"],
    "typescript": ["function_declaration", "generator_function_declaration",
                   "class_declaration", "method_definition", "interface_declaration",
                   "enum_declaration", "type_alias_declaration", "lexical_declaration",
                   "export_statement"],
    "go": ["function_declaration", "method_declaration", "type_declaration"],
    "kotlin": ["function_declaration", "class_declaration", "object_declaration"],
    "java": ["method_declaration", "class_declaration", "interface_declaration",
             "enum_declaration", "constructor_declaration"],
    "c": ["function_definition", "struct_specifier", "enum_specifier", "type_definition"],
    "cpp": ["function_definition", "struct_specifier", "enum_specifier", "class_specifier",
            "template_declaration", "namespace_definition", "type_definition"],
}
CAPTURE["tsx"] = CAPTURE["javascript"] = CAPTURE["typescript"]

# duplicate analysis
CODE_LANGS = ["rust", "typescript", "tsx", "javascript", "python", "go",
              "kotlin", "java", "c", "cpp", "vue"]
EXCLUDED_PATH_PATTERN = (
    r"(/tests?/|(^|/)test_|\.test\.|_test\.|\.spec\."
    r"|\.d\.ts$|/docs/|/fixtures/|/examples?/)")
SIM_THRESHOLD = 0.93

# history mining
NOISE_SUBJECT_PATTERN = (
    r"(?i)^(merge |revert|bump |chore\(deps\)|initial commit|wip$|update readme$)")
PR_SUFFIX_PATTERN = r"\s*\(#\d+\)\s*$"

# ranking features, in contract order
FEATURES = [
    "cos", "distance", "rank", "cos_gap_top", "cos_z", "cos_top1", "same_repo",
    "path_depth", "path_overlap", "symbol_overlap", "has_symbol", "log_text_len",
    "is_code_lang", "is_excluded_path", "same_file_frac",
]
STOPWORDS = ["the", "a", "an", "of", "to", "for", "and", "in", "on", "fix", "add",
             "update", "use", "make", "wip"]
TOKEN_SPLIT_PATTERN = "[^0-9A-Za-z぀-ヿ一-鿿]+"
CAMEL_PATTERN = "(?<=[a-z0-9])(?=[A-Z])"

# SCIP
DEFINITION_ROLE = 1
END_OF_LINE = 1 << 30
SIGIL_KINDS = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}
SYMBOL_KINDS = {
    1: "array", 2: "assertion", 3: "associated_type", 4: "attribute", 5: "axiom",
    6: "boolean", 7: "class", 8: "constant", 9: "constructor", 10: "data_family",
    11: "enum", 12: "enum_member", 13: "event", 14: "fact", 15: "field", 16: "file",
    17: "function", 18: "getter", 19: "grammar", 20: "instance", 21: "interface",
    22: "key", 23: "lang", 24: "lemma", 25: "macro", 26: "method",
    27: "method_receiver", 28: "message", 29: "module", 30: "namespace", 31: "null",
    32: "number", 33: "object", 34: "operator", 35: "package", 36: "package_object",
    37: "parameter", 38: "parameter_label", 39: "pattern", 40: "predicate",
    41: "property", 42: "protocol", 43: "quasiquoter", 44: "self_parameter",
    45: "setter", 46: "signature", 47: "subscript", 48: "string", 49: "struct",
    50: "tactic", 51: "theorem", 52: "this_parameter", 53: "trait", 54: "type",
    55: "type_alias", 56: "type_class", 57: "type_family", 58: "type_parameter",
    59: "union", 60: "value", 61: "variable", 62: "contract", 63: "error",
    64: "library", 65: "modifier", 66: "abstract_method", 67: "method_specification",
    68: "protocol_method", 69: "pure_virtual_method", 70: "trait_method",
    71: "type_class_method", 72: "accessor", 73: "delegate", 74: "method_alias",
    75: "singleton_class", 76: "singleton_method", 77: "static_data_member",
    78: "static_event", 79: "static_field", 80: "static_method",
    81: "static_property", 82: "static_variable", 84: "extension", 85: "mixin",
    86: "concept",
}
