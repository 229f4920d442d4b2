"""Names that are never masked: language words, standard libraries and frameworks.

The lists don't follow the running interpreter: the same text is masked alike by every version of Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fmt: off
# Keywords of Python 3.13.
PYTHON_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
    "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal",
    "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
]

# Built-in names of Python 3.13.
PYTHON_BUILTINS = [
    "ArithmeticError", "AssertionError", "AttributeError", "BaseException", "BaseExceptionGroup", "BlockingIOError",
    "BrokenPipeError", "BufferError", "BytesWarning", "ChildProcessError", "ConnectionAbortedError", "ConnectionError",
    "ConnectionRefusedError", "ConnectionResetError", "DeprecationWarning", "EOFError", "Ellipsis", "EncodingWarning",
    "EnvironmentError", "Exception", "ExceptionGroup", "False", "FileExistsError", "FileNotFoundError",
    "FloatingPointError", "FutureWarning", "GeneratorExit", "IOError", "ImportError", "ImportWarning",
    "IndentationError", "IndexError", "InterruptedError", "IsADirectoryError", "KeyError", "KeyboardInterrupt",
    "LookupError", "MemoryError", "ModuleNotFoundError", "NameError", "None", "NotADirectoryError", "NotImplemented",
    "NotImplementedError", "OSError", "OverflowError", "PendingDeprecationWarning", "PermissionError",
    "ProcessLookupError", "PythonFinalizationError", "RecursionError", "ReferenceError", "ResourceWarning",
    "RuntimeError", "RuntimeWarning", "StopAsyncIteration", "StopIteration", "SyntaxError", "SyntaxWarning",
    "SystemError", "SystemExit", "TabError", "TimeoutError", "True", "TypeError", "UnboundLocalError",
    "UnicodeDecodeError", "UnicodeEncodeError", "UnicodeError", "UnicodeTranslateError", "UnicodeWarning",
    "UserWarning", "ValueError", "Warning", "ZeroDivisionError", "_IncompleteInputError", "__build_class__",
    "__debug__", "__doc__", "__import__", "__loader__", "__name__", "__package__", "__spec__", "abs", "aiter", "all",
    "anext", "any", "ascii", "bin", "bool", "breakpoint", "bytearray", "bytes", "callable", "chr", "classmethod",
    "compile", "complex", "copyright", "credits", "delattr", "dict", "dir", "divmod", "enumerate", "eval", "exec",
    "exit", "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr", "hash", "help", "hex", "id",
    "input", "int", "isinstance", "issubclass", "iter", "len", "license", "list", "locals", "map", "max", "memoryview",
    "min", "next", "object", "oct", "open", "ord", "pow", "print", "property", "quit", "range", "repr", "reversed",
    "round", "set", "setattr", "slice", "sorted", "staticmethod", "str", "sum", "super", "tuple", "type", "vars", "zip",
]

# C++ keywords and common built-in names.
CPP_KEYWORDS = [
    "alignas", "alignof", "and", "and_eq", "asm", "auto", "bitand", "bitor", "bool", "break", "case", "catch", "char",
    "char8_t", "char16_t", "char32_t", "class", "compl", "concept", "const", "consteval", "constexpr", "constinit",
    "const_cast", "continue", "co_await", "co_return", "co_yield", "decltype", "default", "delete", "do", "double",
    "dynamic_cast", "else", "enum", "explicit", "export", "extern", "false", "float", "for", "friend", "goto", "if",
    "inline", "int", "long", "mutable", "namespace", "new", "noexcept", "not", "not_eq", "nullptr", "operator", "or",
    "or_eq", "private", "protected", "public", "register", "reinterpret_cast", "requires", "return", "short", "signed",
    "sizeof", "static", "static_assert", "static_cast", "struct", "switch", "template", "this", "thread_local", "throw",
    "true", "try", "typedef", "typeid", "typename", "union", "unsigned", "using", "virtual", "void", "volatile",
    "wchar_t", "while", "xor", "xor_eq", "override", "final", "main", "argc", "argv", "NULL", "size_t", "ptrdiff_t",
    "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "string", "cout", "cin",
    "cerr", "endl", "std",
]

# Framework names that the Python scan leaves alone.
PYTHON_FRAMEWORK_NAMES = [
    "models", "Model", "Form", "View", "CharField", "IntegerField", "FloatField", "BooleanField", "DateTimeField",
    "ForeignKey", "ManyToManyField", "OneToOneField", "Manager", "QuerySet", "Flask", "Blueprint", "request",
    "Response", "jsonify", "render_template", "redirect", "url_for", "abort", "FastAPI", "APIRouter", "Depends",
    "HTTPException", "Body", "Query", "Column", "String", "Integer", "Float", "Boolean", "DateTime", "ForeignKey",
    "relationship", "backref", "Base", "BaseModel", "Field", "validator", "Module", "Tensor", "nn", "optim",
    "DataLoader", "Dataset", "forward", "backward", "TestCase", "setUp", "tearDown", "test_",
]

# Registry of library names by (language, profile, category).
REGISTRY = {
    ("cpp", "stl", "namespaces"): ["std", "std::chrono", "std::filesystem", "std::regex", "std::this_thread", "std::placeholders"],
    ("cpp", "stl", "types"): [
        "vector", "list", "deque", "array", "forward_list", "set", "multiset", "unordered_set", "unordered_multiset",
        "map", "multimap", "unordered_map", "unordered_multimap", "stack", "queue", "priority_queue", "string",
        "wstring", "u16string", "u32string", "string_view", "basic_string", "unique_ptr", "shared_ptr", "weak_ptr",
        "auto_ptr", "pair", "tuple", "optional", "variant", "any", "function", "reference_wrapper", "iostream",
        "istream", "ostream", "fstream", "ifstream", "ofstream", "stringstream", "istringstream", "ostringstream",
        "iterator", "const_iterator", "reverse_iterator", "thread", "mutex", "lock_guard", "unique_lock",
        "condition_variable", "future", "promise", "atomic", "allocator", "exception", "runtime_error", "logic_error",
        "invalid_argument", "out_of_range", "overflow_error",
    ],
    ("cpp", "stl", "functions"): [
        "sort", "find", "find_if", "count", "count_if", "transform", "for_each", "copy", "move", "fill", "replace",
        "remove", "remove_if", "unique", "reverse", "rotate", "shuffle", "min", "max", "minmax", "clamp", "accumulate",
        "reduce", "inner_product", "binary_search", "lower_bound", "upper_bound", "merge", "partition", "nth_element",
        "cout", "cin", "cerr", "clog", "endl", "flush", "getline", "put", "get", "abs", "sqrt", "pow", "exp", "log",
        "log2", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "ceil", "floor", "round", "fmod",
        "make_unique", "make_shared", "make_pair", "make_tuple", "to_string", "stoi", "stol", "stof", "stod", "swap",
        "exchange", "forward", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "printf", "fprintf",
        "sprintf", "snprintf", "malloc", "calloc", "realloc", "free", "memcpy", "memset", "memmove", "memcmp", "strlen",
        "strcmp", "strncmp", "strcpy", "strncpy", "fopen", "fclose", "fread", "fwrite", "assert",
    ],
    ("python", "stdlib", "modules"): [
        "os", "sys", "re", "json", "math", "random", "time", "datetime", "collections", "itertools", "functools",
        "operator", "typing", "pathlib", "shutil", "glob", "tempfile", "io", "subprocess", "threading",
        "multiprocessing", "concurrent", "socket", "http", "urllib", "email", "hashlib", "hmac", "secrets", "logging",
        "warnings", "traceback", "unittest", "pytest", "doctest", "abc", "enum", "dataclasses", "copy", "pickle",
        "shelve", "csv", "argparse", "configparser", "contextlib", "inspect", "importlib", "textwrap", "string",
        "struct", "array", "queue", "asyncio", "aiohttp",
    ],
    ("python", "django", "base_classes"): [
        "Model", "Form", "ModelForm", "View", "TemplateView", "ListView", "DetailView", "CreateView", "UpdateView",
        "DeleteView", "APIView", "ViewSet", "ModelViewSet", "Serializer", "ModelSerializer", "Admin", "ModelAdmin",
        "TestCase", "TransactionTestCase", "SimpleTestCase", "Command", "BaseCommand", "Middleware",
    ],
    ("python", "django", "safe_methods"): [
        "objects", "filter", "get", "create", "update", "delete", "exclude", "order_by", "values", "annotate",
        "aggregate", "select_related", "prefetch_related", "save", "full_clean", "clean", "validate", "render",
        "redirect", "reverse", "resolve",
    ],
    ("python", "django", "decorators"): ["login_required", "permission_required", "csrf_exempt", "require_http_methods", "api_view"],
    ("python", "flask", "base_classes"): ["Flask", "Blueprint", "Resource", "MethodView"],
    ("python", "flask", "safe_methods"): [
        "route", "before_request", "after_request", "errorhandler", "register_blueprint", "render_template", "redirect",
        "url_for", "jsonify", "abort", "make_response", "send_file", "send_from_directory",
    ],
    ("python", "flask", "objects"): ["request", "session", "g", "current_app"],
    ("python", "fastapi", "base_classes"): ["FastAPI", "APIRouter", "BaseModel"],
    ("python", "fastapi", "safe_methods"): [
        "get", "post", "put", "delete", "patch", "Depends", "HTTPException", "Body", "Query", "Path", "Header",
        "Cookie", "File", "Form", "BackgroundTasks", "Response", "JSONResponse",
    ],
    ("python", "sqlalchemy", "base_classes"): ["Base", "DeclarativeBase", "Session"],
    ("python", "sqlalchemy", "safe_methods"): [
        "Column", "Integer", "String", "Float", "Boolean", "DateTime", "Text", "ForeignKey", "Table", "relationship",
        "backref", "mapped_column", "create_engine", "sessionmaker", "query", "add", "commit", "rollback", "flush",
    ],
    ("python", "pydantic", "base_classes"): ["BaseModel", "BaseSettings"],
    ("python", "pydantic", "safe_methods"): [
        "Field", "validator", "root_validator", "model_validator", "field_validator", "ConfigDict", "model_dump",
        "model_validate",
    ],
    ("python", "pytorch", "base_classes"): ["Module", "Dataset", "DataLoader", "Optimizer"],
    ("python", "pytorch", "safe_methods"): [
        "forward", "backward", "parameters", "named_parameters", "state_dict", "load_state_dict", "train", "eval",
        "zero_grad", "step", "cuda", "cpu", "to", "tensor", "zeros", "ones", "randn", "rand", "cat", "stack", "reshape",
        "view", "permute", "Linear", "Conv2d", "BatchNorm2d", "ReLU", "Dropout", "CrossEntropyLoss", "MSELoss", "Adam",
        "SGD",
    ],
    ("python", "pytorch", "modules"): ["torch", "nn", "optim", "F", "torchvision", "transforms"],
}
# fmt: on


def python_names() -> list[str]:
    """Built-ins and keywords, plus self, cls and the framework names."""
    return sorted({*PYTHON_BUILTINS, *PYTHON_KEYWORDS, "self", "cls", *PYTHON_FRAMEWORK_NAMES})


def cpp_names() -> list[str]:
    return sorted(set(CPP_KEYWORDS))


# The few words of running text that carry no name.
PROSE_KEYWORDS = sorted(PYTHON_KEYWORDS)


def protected_names(language: str) -> list[str]:
    """What a scan in this language must leave as it is."""
    if language == "python":
        return python_names()
    if language == "cpp":
        return cpp_names()
    return PROSE_KEYWORDS


def registry_rows() -> list[tuple[str, str, str, str]]:
    """(name, language, profile, category), one row per entry."""
    return [
        (name, language, profile, category)
        for (language, profile, category), names in REGISTRY.items()
        for name in dict.fromkeys(names)
    ]


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a dimension table; a few hundred rows, always fit to broadcast."""
    return spark.createDataFrame(
        registry_rows(), "name string, language string, profile string, category string"
    )
