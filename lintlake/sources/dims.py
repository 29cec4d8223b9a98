"""Language, binary and ignore tables.  All of it is fixed values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# (extension, language, family, comment marker).  Case matters: .R and .r both exist.
EXTENSIONS = [
    (".js", "JavaScript", "js", "//"),
    (".mjs", "JavaScript (ESM)", "js", "//"),
    (".cjs", "JavaScript (CJS)", "js", "//"),
    (".jsx", "React JSX", "js", "//"),
    (".ts", "TypeScript", "ts", "//"),
    (".tsx", "TypeScript React", "ts", "//"),
    (".vue", "Vue", "js", "//"),
    (".svelte", "Svelte", "js", "//"),
    (".astro", "Astro", "js", "//"),
    (".coffee", "CoffeeScript", "coffee", "#"),
    (".css", "CSS", "css", "/*"),
    (".scss", "SCSS", "css", "//"),
    (".sass", "Sass", "css", "//"),
    (".less", "Less", "css", "//"),
    (".styl", "Stylus", "css", "//"),
    (".html", "HTML", "html", "<!--"),
    (".htm", "HTML", "html", "<!--"),
    (".xml", "XML", "xml", "<!--"),
    (".xhtml", "XHTML", "html", "<!--"),
    (".svg", "SVG", "xml", "<!--"),
    (".pug", "Pug", "html", "//"),
    (".ejs", "EJS", "html", "<%#"),
    (".hbs", "Handlebars", "html", "{{!"),
    (".mustache", "Mustache", "html", "{{!"),
    (".njk", "Nunjucks", "html", "{#"),
    (".twig", "Twig", "html", "{#"),
    (".erb", "ERB", "html", "<%#"),
    (".haml", "Haml", "html", "-#"),
    (".slim", "Slim", "html", "/"),
    (".blade.php", "Blade", "html", "{{--"),
    (".jsp", "JSP", "html", "<%--"),
    (".py", "Python", "python", "#"),
    (".pyw", "Python (Windows)", "python", "#"),
    (".pyx", "Cython", "python", "#"),
    (".pxd", "Cython Declaration", "python", "#"),
    (".pyi", "Python Stub", "python", "#"),
    (".ipynb", "Jupyter Notebook", "python", "#"),
    (".rb", "Ruby", "ruby", "#"),
    (".rake", "Rake", "ruby", "#"),
    (".gemspec", "Gemspec", "ruby", "#"),
    (".php", "PHP", "php", "//"),
    (".phtml", "PHP Template", "php", "//"),
    (".java", "Java", "java", "//"),
    (".kt", "Kotlin", "kotlin", "//"),
    (".kts", "Kotlin Script", "kotlin", "//"),
    (".scala", "Scala", "scala", "//"),
    (".groovy", "Groovy", "groovy", "//"),
    (".gradle", "Gradle", "groovy", "//"),
    (".clj", "Clojure", "clojure", ";"),
    (".cljs", "ClojureScript", "clojure", ";"),
    (".cs", "C#", "csharp", "//"),
    (".csx", "C# Script", "csharp", "//"),
    (".fs", "F#", "fsharp", "//"),
    (".fsx", "F# Script", "fsharp", "//"),
    (".vb", "Visual Basic", "vb", "'"),
    (".razor", "Razor", "csharp", "//"),
    (".cshtml", "Razor HTML", "csharp", "//"),
    (".c", "C", "c", "//"),
    (".h", "C Header", "c", "//"),
    (".cpp", "C++", "cpp", "//"),
    (".cxx", "C++", "cpp", "//"),
    (".cc", "C++", "cpp", "//"),
    (".hpp", "C++ Header", "cpp", "//"),
    (".hxx", "C++ Header", "cpp", "//"),
    (".m", "Objective-C", "objc", "//"),
    (".mm", "Objective-C++", "objc", "//"),
    (".rs", "Rust", "rust", "//"),
    (".go", "Go", "go", "//"),
    (".zig", "Zig", "zig", "//"),
    (".nim", "Nim", "nim", "#"),
    (".v", "V", "vlang", "//"),
    (".d", "D", "d", "//"),
    (".ada", "Ada", "ada", "--"),
    (".adb", "Ada Body", "ada", "--"),
    (".ads", "Ada Spec", "ada", "--"),
    (".pas", "Pascal", "pascal", "//"),
    (".pp", "Pascal", "pascal", "//"),
    (".f", "Fortran", "fortran", "!"),
    (".f90", "Fortran 90", "fortran", "!"),
    (".f95", "Fortran 95", "fortran", "!"),
    (".f03", "Fortran 2003", "fortran", "!"),
    (".for", "Fortran", "fortran", "!"),
    (".cob", "COBOL", "cobol", "*>"),
    (".cbl", "COBOL", "cobol", "*>"),
    (".swift", "Swift", "swift", "//"),
    (".hs", "Haskell", "haskell", "--"),
    (".lhs", "Literate Haskell", "haskell", "--"),
    (".ml", "OCaml", "ocaml", "(*"),
    (".mli", "OCaml Interface", "ocaml", "(*"),
    (".ex", "Elixir", "elixir", "#"),
    (".exs", "Elixir Script", "elixir", "#"),
    (".erl", "Erlang", "erlang", "%"),
    (".hrl", "Erlang Header", "erlang", "%"),
    (".elm", "Elm", "elm", "--"),
    (".gleam", "Gleam", "gleam", "//"),
    (".rkt", "Racket", "racket", ";"),
    (".scm", "Scheme", "scheme", ";"),
    (".lisp", "Common Lisp", "lisp", ";"),
    (".cl", "Common Lisp", "lisp", ";"),
    (".sh", "Shell", "shell", "#"),
    (".bash", "Bash", "shell", "#"),
    (".zsh", "Zsh", "shell", "#"),
    (".fish", "Fish", "shell", "#"),
    (".ps1", "PowerShell", "powershell", "#"),
    (".psm1", "PowerShell Module", "powershell", "#"),
    (".psd1", "PowerShell Data", "powershell", "#"),
    (".bat", "Batch", "batch", "REM"),
    (".cmd", "Batch", "batch", "REM"),
    (".lua", "Lua", "lua", "--"),
    (".pl", "Perl", "perl", "#"),
    (".pm", "Perl Module", "perl", "#"),
    (".r", "R", "r", "#"),
    (".R", "R", "r", "#"),
    (".rmd", "R Markdown", "r", "#"),
    (".jl", "Julia", "julia", "#"),
    (".tcl", "Tcl", "tcl", "#"),
    (".awk", "AWK", "awk", "#"),
    (".sed", "Sed", "sed", "#"),
    (".dart", "Dart", "dart", "//"),
    (".json", "JSON", "json", None),
    (".jsonc", "JSON with Comments", "json", "//"),
    (".json5", "JSON5", "json", "//"),
    (".yaml", "YAML", "yaml", "#"),
    (".yml", "YAML", "yaml", "#"),
    (".toml", "TOML", "toml", "#"),
    (".ini", "INI", "ini", ";"),
    (".cfg", "Config", "ini", "#"),
    (".conf", "Config", "ini", "#"),
    (".env", "Environment", "env", "#"),
    (".properties", "Properties", "properties", "#"),
    (".csv", "CSV", "csv", None),
    (".sql", "SQL", "sql", "--"),
    (".graphql", "GraphQL", "graphql", "#"),
    (".gql", "GraphQL", "graphql", "#"),
    (".prisma", "Prisma", "prisma", "//"),
    (".md", "Markdown", "markdown", None),
    (".mdx", "MDX", "markdown", None),
    (".rst", "reStructuredText", "rst", ".."),
    (".tex", "LaTeX", "latex", "%"),
    (".txt", "Plain Text", "text", None),
    (".adoc", "AsciiDoc", "asciidoc", "//"),
    (".tf", "Terraform", "hcl", "#"),
    (".hcl", "HCL", "hcl", "#"),
    (".tfvars", "Terraform Vars", "hcl", "#"),
    (".proto", "Protocol Buffers", "proto", "//"),
    (".thrift", "Thrift", "thrift", "//"),
    (".nix", "Nix", "nix", "#"),
    (".dhall", "Dhall", "dhall", "--"),
    (".wat", "WebAssembly Text", "wasm", ";;"),
    (".wast", "WebAssembly Script", "wasm", ";;"),
    (".sol", "Solidity", "solidity", "//"),
    (".vy", "Vyper", "vyper", "#"),
    (".move", "Move", "move", "//"),
    (".gd", "GDScript", "gdscript", "#"),
    (".gdshader", "Godot Shader", "shader", "//"),
    (".shader", "Unity Shader", "shader", "//"),
    (".hlsl", "HLSL", "shader", "//"),
    (".glsl", "GLSL", "shader", "//"),
    (".wgsl", "WGSL", "shader", "//"),
]

# (file name, language, family, comment marker)
FILE_NAMES = [
    ("Dockerfile", "Dockerfile", "docker", "#"),
    ("docker-compose.yml", "Docker Compose", "yaml", "#"),
    ("docker-compose.yaml", "Docker Compose", "yaml", "#"),
    ("Makefile", "Makefile", "make", "#"),
    ("GNUmakefile", "Makefile", "make", "#"),
    ("CMakeLists.txt", "CMake", "cmake", "#"),
    ("Gemfile", "Gemfile", "ruby", "#"),
    ("Rakefile", "Rakefile", "ruby", "#"),
    ("Vagrantfile", "Vagrantfile", "ruby", "#"),
    ("Cargo.toml", "Cargo Config", "toml", "#"),
    ("Cargo.lock", "Cargo Lock", "toml", "#"),
    ("go.mod", "Go Module", "go", "//"),
    ("go.sum", "Go Checksum", "text", None),
    ("package.json", "npm Config", "json", None),
    ("tsconfig.json", "TypeScript Config", "json", None),
    ("webpack.config.js", "Webpack Config", "js", "//"),
    ("vite.config.ts", "Vite Config", "ts", "//"),
    ("vite.config.js", "Vite Config", "js", "//"),
    (".gitignore", "Git Ignore", "gitignore", "#"),
    (".dockerignore", "Docker Ignore", "gitignore", "#"),
    (".editorconfig", "EditorConfig", "ini", "#"),
    (".eslintrc", "ESLint Config", "json", None),
    (".prettierrc", "Prettier Config", "json", None),
    ("Pipfile", "Pipfile", "toml", "#"),
    ("Procfile", "Procfile", "text", "#"),
    ("Jenkinsfile", "Jenkinsfile", "groovy", "//"),
    ("justfile", "Justfile", "make", "#"),
    ("BUILD", "Bazel", "python", "#"),
    ("BUILD.bazel", "Bazel", "python", "#"),
    ("WORKSPACE", "Bazel Workspace", "python", "#"),
    (".bazelrc", "Bazel Config", "ini", "#"),
    ("meson.build", "Meson", "python", "#"),
    ("SConstruct", "SCons", "python", "#"),
    ("SConscript", "SCons", "python", "#"),
    ("flake.nix", "Nix Flake", "nix", "#"),
    ("default.nix", "Nix", "nix", "#"),
    ("shell.nix", "Nix Shell", "nix", "#"),
]

# (extension, language) of the basic profile
BASIC_EXTENSIONS = [
    (".js", "JavaScript"),
    (".jsx", "JavaScript (React)"),
    (".ts", "TypeScript"),
    (".tsx", "TypeScript (React)"),
    (".vue", "Vue"),
    (".svelte", "Svelte"),
    (".py", "Python"),
    (".rb", "Ruby"),
    (".php", "PHP"),
    (".java", "Java"),
    (".kt", "Kotlin"),
    (".go", "Go"),
    (".rs", "Rust"),
    (".c", "C"),
    (".cpp", "C++"),
    (".h", "C/C++ Header"),
    (".hpp", "C++ Header"),
    (".cs", "C#"),
    (".html", "HTML"),
    (".css", "CSS"),
    (".scss", "SCSS"),
    (".sass", "Sass"),
    (".less", "Less"),
    (".json", "JSON"),
    (".yaml", "YAML"),
    (".yml", "YAML"),
    (".xml", "XML"),
    (".toml", "TOML"),
    (".md", "Markdown"),
    (".sh", "Shell"),
    (".bash", "Bash"),
    (".sql", "SQL"),
    (".graphql", "GraphQL"),
]

IGNORED_DIRS = [
    "node_modules",
    ".git",
    ".svn",
    ".hg",
    ".bzr",
    "vendor",
    "vendors",
    "third_party",
    "3rdparty",
    "dist",
    "build",
    "out",
    "output",
    "_build",
    "target",
    ".next",
    ".nuxt",
    ".output",
    ".vercel",
    ".netlify",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    ".ruff_cache",
    "venv",
    ".venv",
    "env",
    ".env",
    "coverage",
    ".nyc_output",
    ".coverage",
    "bin",
    "obj",
    ".gradle",
    ".idea",
    ".vscode",
    ".vs",
    ".dart_tool",
    ".pub-cache",
    "Pods",
    ".terraform",
    ".terragrunt-cache",
    "zig-cache",
    "zig-out",
    ".cargo",
    "elm-stuff",
    "_deps",
    "bower_components",
    ".cache",
    ".parcel-cache",
    "tmp",
    "temp",
    ".turbo",
    ".nx",
    "deps",
    "_opam",
]

BINARY_EXTENSIONS = [
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".ico",
    ".bmp",
    ".tiff",
    ".webp",
    ".avif",
    ".svg",
    ".woff",
    ".woff2",
    ".ttf",
    ".eot",
    ".otf",
    ".mp3",
    ".mp4",
    ".wav",
    ".avi",
    ".mov",
    ".flac",
    ".ogg",
    ".webm",
    ".mkv",
    ".pdf",
    ".doc",
    ".docx",
    ".xls",
    ".xlsx",
    ".ppt",
    ".pptx",
    ".zip",
    ".tar",
    ".gz",
    ".bz2",
    ".rar",
    ".7z",
    ".xz",
    ".zst",
    ".exe",
    ".dll",
    ".so",
    ".dylib",
    ".a",
    ".lib",
    ".o",
    ".obj",
    ".class",
    ".jar",
    ".war",
    ".pyc",
    ".pyo",
    ".whl",
    ".egg",
    ".db",
    ".sqlite",
    ".sqlite3",
    ".mdb",
    ".bin",
    ".dat",
    ".iso",
    ".img",
    ".dmg",
    ".lock",
    ".map",
    ".min.js",
    ".min.css",
]
# Compared with the lower-cased file name.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock"]
BUNDLE_SUFFIXES = [".min.js", ".min.css", ".bundle.js", ".chunk.js"]

BASIC_IGNORED = [
    "node_modules",
    "vendor",
    "dist",
    "build",
    ".git",
    ".next",
    "__pycache__",
    ".pytest_cache",
    "coverage",
    ".nyc_output",
    "target",
    "bin",
    "obj",
]
BASIC_BINARY = [
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".ico",
    ".svg",
    ".woff",
    ".woff2",
    ".ttf",
    ".eot",
    ".otf",
    ".mp3",
    ".mp4",
    ".wav",
    ".avi",
    ".mov",
    ".pdf",
    ".doc",
    ".docx",
    ".xls",
    ".xlsx",
    ".zip",
    ".tar",
    ".gz",
    ".rar",
    ".7z",
    ".exe",
    ".dll",
    ".so",
    ".dylib",
]
BASIC_SUPPORTED = [
    ".js",
    ".jsx",
    ".ts",
    ".tsx",
    ".vue",
    ".svelte",
    ".py",
    ".rb",
    ".php",
    ".java",
    ".kt",
    ".go",
    ".rs",
    ".c",
    ".cpp",
    ".h",
    ".hpp",
    ".cs",
    ".html",
    ".css",
    ".scss",
    ".sass",
    ".less",
    ".json",
    ".yaml",
    ".yml",
    ".xml",
    ".toml",
    ".md",
    ".txt",
    ".sh",
    ".bash",
    ".zsh",
    ".sql",
    ".graphql",
    ".prisma",
    ".env",
    ".gitignore",
    ".dockerignore",
    "Dockerfile",
    "Makefile",
    "Gemfile",
    "Cargo.toml",
    "package.json",
]

MAX_FILE_BYTES = 1024 * 1024


def _table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    cols = {n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)}
    return spark.createDataFrame(pa.table(cols))


def lang_ext_dim(spark: SparkSession) -> DataFrame:
    return _table(spark, ["key", "name", "family", "comment"], EXTENSIONS)


def lang_file_dim(spark: SparkSession) -> DataFrame:
    return _table(spark, ["key", "name", "family", "comment"], FILE_NAMES)


def lang_basic_dim(spark: SparkSession) -> DataFrame:
    return _table(spark, ["key", "name"], BASIC_EXTENSIONS)
