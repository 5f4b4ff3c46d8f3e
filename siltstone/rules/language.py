"""How a language is told from a file name, a first line or the text."""

# Extension, language, confidence.
EXTENSIONS = [
    (".ts", "TypeScript", 0.98), (".tsx", "TypeScript", 0.98), (".js", "JavaScript", 0.97), (".jsx", "JavaScript", 0.97),
    (".mjs", "JavaScript", 0.97), (".cjs", "JavaScript", 0.97), (".py", "Python", 0.99), (".pyw", "Python", 0.99),
    (".go", "Go", 0.99), (".rs", "Rust", 0.99), (".java", "Java", 0.99), (".kt", "Kotlin", 0.99), (".kts", "Kotlin", 0.99),
    (".cs", "C#", 0.99), (".c", "C", 0.98), (".cpp", "C++", 0.98), (".cc", "C++", 0.98), (".cxx", "C++", 0.98),
    (".h", "C/C++", 0.85), (".hpp", "C++", 0.97), (".rb", "Ruby", 0.99), (".php", "PHP", 0.99), (".swift", "Swift", 0.99),
    (".sql", "SQL", 0.99), (".yaml", "YAML", 0.99), (".yml", "YAML", 0.99), (".json", "JSON", 0.99), (".xml", "XML", 0.99),
    (".html", "HTML", 0.99), (".htm", "HTML", 0.99), (".css", "CSS", 0.99), (".scss", "SCSS", 0.99), (".sass", "Sass", 0.99),
    (".less", "Less", 0.99), (".sh", "Shell", 0.99), (".bash", "Shell", 0.99), (".zsh", "Shell", 0.99), (".fish", "Shell", 0.99),
    (".md", "Markdown", 0.99), (".mdx", "MDX", 0.98), (".vue", "Vue", 0.99), (".svelte", "Svelte", 0.99),
    (".graphql", "GraphQL", 0.99), (".gql", "GraphQL", 0.99), (".proto", "Protocol Buffers", 0.99), (".toml", "TOML", 0.99),
    (".env", "Environment Config", 0.90), (".dockerfile", "Dockerfile", 0.99), (".tf", "Terraform (HCL)", 0.99), (".hcl", "HCL", 0.99),
    (".r", "R", 0.97), (".scala", "Scala", 0.99), (".clj", "Clojure", 0.99), (".ex", "Elixir", 0.99), (".exs", "Elixir", 0.99),
    (".lua", "Lua", 0.99), (".zig", "Zig", 0.99), (".txt", "Plain Text", 0.60),
]

# Extension, display label.
DISPLAY = [
    (".ts", "TypeScript"), (".tsx", "TypeScript / React"), (".js", "JavaScript"), (".jsx", "JavaScript / React"), (".py", "Python"),
    (".java", "Java"), (".go", "Go"), (".rs", "Rust"), (".c", "C"), (".cpp", "C++"), (".h", "C/C++ Header"), (".hpp", "C++ Header"),
    (".cs", "C#"), (".php", "PHP"), (".rb", "Ruby"), (".swift", "Swift"), (".kt", "Kotlin"), (".sql", "SQL"), (".yaml", "YAML"),
    (".yml", "YAML"), (".json", "JSON"), (".xml", "XML"), (".html", "HTML"), (".css", "CSS"), (".scss", "SCSS"), (".md", "Markdown"),
    (".sh", "Shell"), (".bash", "Bash"), (".dockerfile", "Dockerfile"), (".env", "Environment Config"), (".txt", "Plain Text"),
    (".vue", "Vue"), (".svelte", "Svelte"),
]

# First-line pattern, language.
SHEBANGS = [
    (r"^#!.*\bpython3?\b", "Python"),
    (r"^#!.*\bnode\b", "JavaScript"),
    (r"^#!.*\b(bash|sh|zsh|fish|dash)\b", "Shell"),
    (r"^#!.*\bruby\b", "Ruby"),
    (r"^#!.*\bperl\b", "Perl"),
    (r"^#!.*\bphp\b", "PHP"),
]
SHEBANG_CONFIDENCE, DOCKERFILE_CONFIDENCE, UNKNOWN_CONFIDENCE, WEAK_FACTOR, SAMPLE = 0.92, 0.99, 0.10, 0.65, 1200

# Language, confidence, patterns that must all match, patterns of which one must match. A pattern is (source, flags).
HEURISTICS = [
    ("TypeScript", 0.82, [(r"\b(interface|type\s+\w+\s*=|:\s*(string|number|boolean|void|never|unknown|any)\b)", ""), (r"\b(as\s+const|readonly\s+|Promise<|Record<|Partial<|Required<)", "")],
     [(r"\b(interface\s+\w+|type\s+\w+\s*=|:\s*string|: number|: boolean|as const|readonly )\b", "")]),
    ("TypeScript", 0.85, [(r"import React|from ['\"]react['\"]", ""), (r"return\s*\(\s*<", "")],
     [(r"<[A-Z][a-zA-Z]*[\s/>]|JSX\.Element|React\.FC", "")]),
    ("JavaScript", 0.70, [(r"\b(const|let|var)\s+\w+\s*=", ""), (r"\b(require\(|module\.exports|exports\.\w+)", "")],
     [(r"\b(require\(|module\.exports|=>|async\s+function)\b", "")]),
    ("Python", 0.88, [(r"\b(def\s+\w+\s*\(|class\s+\w+(\([\w,\s]*\))?:)", ""), (r"\b(import\s+\w+|from\s+\w+\s+import)", "")],
     [(r"\b(def |print\(|if __name__|lambda |elif )\b", "")]),
    ("Go", 0.90, [(r"^package\s+[a-z]+", "m"), (r"\bfunc\s+[A-Za-z]", "")],
     [(r"\b(func |fmt\.|go func|chan |defer |goroutine)\b", "")]),
    ("Rust", 0.90, [(r"\b(fn\s+\w+|let\s+mut\s+|impl\s+\w+)", ""), (r"\b(use\s+std::|pub\s+(struct|enum|fn)|#\[derive)", "")],
     [(r"\b(fn |let mut|impl |use std::|println!|unwrap\(\))\b", "")]),
    ("Java", 0.88, [(r"\b(public\s+class|private\s+|protected\s+)\w", ""), (r"\b(import\s+java\.|System\.out\.println|@Override)\b", "")],
     [(r"\b(public class|private void|@Override|new \w+\()\b", "")]),
    ("C#", 0.87, [(r"\b(namespace\s+\w+|using\s+System)", ""), (r"\b(public\s+(class|interface|enum|struct)|private\s+(void|int|string))\b", "")],
     [(r"\b(namespace |using System|Console\.Write|var |\.NET)\b", "")]),
    ("SQL", 0.88, [(r"^\s*(SELECT\s+.+\s+FROM|INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM|CREATE\s+TABLE)", "im")],
     [(r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|DROP TABLE)\b", "i")]),
    ("Shell", 0.80, [(r"^(export\s+\w+=|source\s+|chmod\s+|sudo\s+|apt\s+|brew\s+)", "m"), (r"\$\{?\w+\}?|\$\(.*\)", "")],
     [(r"\b(echo |grep |awk |sed |chmod |curl |wget )\b", "")]),
    ("YAML", 0.72, [(r"^[a-zA-Z_][a-zA-Z0-9_-]*:\s+\S", "m"), (r"^\s+-\s+\w+", "m")],
     [(r"^---\s*$", "m")]),
    ("JSON", 0.85, [(r"^\s*[{\[]", "")],
     [(r"\"[^\"]+\"\s*:", "")]),
    ("HTML", 0.92, [(r"<!DOCTYPE html|<html[\s>]", "i")],
     [(r"<(head|body|div|span|p|a)\s*[\s>]", "i")]),
    ("CSS", 0.82, [(r"[.#][\w-]+\s*\{[^}]+\}", ""), (r"@(media|keyframes|import|font-face)", "")],
     [(r"\{[^}]*:[^}]*;[^}]*\}", "")]),
    ("Markdown", 0.70, [(r"^#{1,6}\s+\S", "m"), (r"^\[.+\]\(.+\)", "m")],
     [(r"^[-*]\s+\w", "m")]),
    ("GraphQL", 0.90, [(r"\b(type\s+\w+\s*\{|query\s+\w+|mutation\s+\w+|fragment\s+\w+\s+on)\b", "")],
     [(r"\b(Query|Mutation|Subscription|schema\s*\{)\b", "")]),
]
