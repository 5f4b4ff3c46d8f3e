"""Artifact role rules."""

SAMPLE, FILENAME_BONUS, FINAL_CAP, LEAST = 3000, 0.10, 0.98, 0.52
LABELS = [
    ("react-component", "React component"), ("api-route", "API route handler"), ("middleware", "Middleware function"), ("hook", "React hook"),
    ("context-provider", "React context provider"), ("schema-model", "Schema/model definition"), ("utility", "Utility module"),
    ("config", "Configuration file"), ("auth-module", "Authentication module"), ("database-layer", "Database access layer"),
    ("test-file", "Test file"), ("store", "State store"), ("service", "Service class"),
]

# Name, base, step, maximum, [(file name pattern, flags)], [(text pattern, flags)].
RULES = [
    ("test-file", 0.82, 0.05, 0.98, [(r"\.(test|spec)\.[tj]sx?$", ""), (r"__tests__", "")], [
        (r"\b(describe|it|test|beforeEach|afterEach|beforeAll|afterAll)\s*\(", ""), (r"\b(expect|assert|should)\s*\(", ""),
        (r"from ['\"]vitest['\"]|from ['\"]jest['\"]|from ['\"]@testing-library\/", ""), (r"\bvi\.fn\(\)|jest\.fn\(\)|jest\.mock\(|vi\.mock\(", ""),
    ]),
    ("react-component", 0.72, 0.07, 0.96, [(r"[A-Z][a-zA-Z]*\.(tsx|jsx)$", "")], [
        (r"export\s+(default\s+)?function\s+[A-Z][a-zA-Z]*\s*\(", ""), (r"return\s*\(\s*<", ""), (r"React\.FC|React\.ReactNode|JSX\.Element", ""),
        (r"\b(useState|useEffect|useRef|useCallback|useMemo)\s*\(", ""), (r"props\s*:\s*\{|interface\s+\w+Props\s*\{", ""), (r"<[A-Z][a-zA-Z]*[\s/>]", ""),
    ]),
    ("hook", 0.76, 0.07, 0.97, [(r"^use[A-Z].*\.[tj]sx?$", "")], [
        (r"export\s+(default\s+)?function\s+use[A-Z][a-zA-Z]*\s*\(", ""), (r"\b(useState|useEffect|useRef|useCallback|useMemo|useReducer|useContext)\s*\(", ""),
        (r"return\s*\{[^}]*\}", ""),
    ]),
    ("context-provider", 0.78, 0.07, 0.96, [(r"context\.[tj]sx?$|provider\.[tj]sx?$", "i")], [
        (r"createContext\s*\(", ""), (r"\bProvider\b.*\bvalue\s*=\s*\{", ""), (r"export\s+const\s+use[A-Z]\w+Context\s*=", ""),
        (r"\bContextType\b|\bReact\.createContext\b", ""),
    ]),
    ("api-route", 0.74, 0.08, 0.97, [(r"route\.[tj]s$|route\.tsx$|api\/", "")], [
        (r"export\s+(default\s+)?async\s+function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(", ""), (r"export\s+(default\s+)?function\s+handler\s*\(", ""),
        (r"\bNextRequest\b|\bNextResponse\b", ""), (r"\bRequest\b.*\bResponse\b|\bResponse\.json\s*\(", ""), (r"res\.(json|send|status)\s*\(", ""),
    ]),
    ("middleware", 0.76, 0.07, 0.96, [(r"middleware\.[tj]sx?$", "i")], [
        (r"export\s+(default\s+)?function\s+middleware\s*\(", ""), (r"NextResponse\.next\s*\(|NextResponse\.redirect\s*\(", ""),
        (r"\(req\s*,\s*res\s*,\s*next\s*\)", ""), (r"export\s+const\s+config\s*=\s*\{\s*matcher", ""),
    ]),
    ("auth-module", 0.72, 0.07, 0.95, [(r"auth\.[tj]sx?$|session\.[tj]sx?$|jwt\.[tj]sx?$", "i")], [
        (r"\b(jwt|jsonwebtoken|bcrypt|argon2|passport)\b", ""), (r"\b(signIn|signOut|getSession|useSession|authenticate)\s*\(", ""),
        (r"\b(accessToken|refreshToken|bearerToken|authToken)\b", ""), (r"from ['\"]next-auth|from ['\"]@auth\/", ""), (r"\bAuthOptions\b|\bNextAuth\s*\(", ""),
    ]),
    ("schema-model", 0.68, 0.07, 0.93, [(r"\.schema\.[tj]sx?$", "i"), (r"\.model\.[tj]sx?$", "i"), (r"\b(types?|interfaces?|dto)\.[tj]sx?$", "i")], [
        (r"\bz\.(object|string|number|array|enum|union)\s*\(", ""), (r"\btype\s+\w+\s*=\s*\{", ""), (r"\binterface\s+\w+\s*\{", ""),
        (r"\benum\s+\w+\s*\{", ""), (r"export\s+type\s+\w+|export\s+interface\s+\w+", ""),
    ]),
    ("database-layer", 0.72, 0.07, 0.95, [(r"\b(db|database|repository|repo)\.[tj]s$", "i")], [
        (r"from ['\"]@prisma\/client['\"]", ""), (r"from ['\"]mongoose['\"]|mongoose\.model", ""),
        (r"\b(findMany|findFirst|findById|create|updateOne|deleteOne)\s*\(", ""), (r"\bPrismaClient\b|\bMongoose\b|\bSequelize\b|\bTypeORM\b", ""),
        (r"new Schema\s*\(\{", ""),
    ]),
    ("store", 0.74, 0.07, 0.95, [(r"\b(store|slice|atom|reducer)\.[tj]sx?$", "i")], [
        (r"\bcreateSlice\s*\(|createStore\s*\(", ""), (r"\batom\s*\(|selector\s*\(", ""), (r"\bcreate\s*\(\s*\(\s*set\s*\)", ""), (r"\buseDispatch\b|\buseSelector\b", ""),
    ]),
    ("service", 0.60, 0.07, 0.88, [(r"\.service\.[tj]sx?$|service\.[tj]sx?$", "i")], [
        (r"@Injectable\s*\(\)", ""), (r"export\s+(default\s+)?class\s+\w+Service\b", ""), (r"\bRepositoryPort\b|\bRepository<\w+>", ""),
    ]),
    ("config", 0.70, 0.05, 0.93, [(r"\.(config|rc)\.[tj]sx?$|\.(yaml|yml|json|toml|env)$", "i"), (r"^(next|tailwind|eslint|vite|jest|vitest|tsconfig|babel|webpack)\.", "")], [
        (r"module\.exports\s*=\s*\{|export\s+default\s*\{", ""), (r"defineConfig\s*\(|withNextConfig\s*\(", ""), (r"^[A-Z_]+\s*=\s*.+$", "m"),
    ]),
    ("utility", 0.55, 0.06, 0.85, [(r"\b(util|utils|helper|helpers|lib|shared)\.[tj]sx?$", "i")], [
        (r"export\s+(const|function)\s+\w+", ""), (r"export\s*\{[^}]+\}", ""),
    ]),
]
