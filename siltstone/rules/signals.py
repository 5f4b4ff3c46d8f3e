"""Capability signals and dependency patterns."""

# Signal, [(pattern, flags, evidence)].
RULES = [
    ("authentication", [
        (r"\b(jwt|jsonwebtoken|bcrypt|argon2|passport)\b", "i", "auth library (jwt/bcrypt/passport)"),
        (r"\b(signIn|signOut|getSession|getServerSession|useSession)\s*\(", "", "auth session function"),
        (r"\b(Authorization|Bearer|accessToken|refreshToken|authToken)\b", "", "auth token/header reference"),
        (r"from ['\"]next-auth|from ['\"]@auth\/|from ['\"]passport", "", "auth library import"),
        (r"\b(login|logout|authenticate|verifyToken|hashPassword)\s*\(", "", "auth function call"),
    ]),
    ("database", [
        (r"from ['\"]@prisma\/client['\"]", "", "Prisma client import"),
        (r"from ['\"]mongoose['\"]|mongoose\.connect", "", "Mongoose import/connect"),
        (r"from ['\"]pg['\"]|from ['\"]mysql2['\"]|from ['\"]sqlite3['\"]", "", "raw DB driver import"),
        (r"\b(findMany|findFirst|findById|updateOne|deleteOne|insertOne)\s*\(", "", "database query method"),
        (r"\b(PrismaClient|MongoClient|Sequelize|TypeORM|Knex)\b", "", "ORM/DB client reference"),
        (r"\.(query|execute|transaction)\s*\(", "", "raw SQL query/execute call"),
    ]),
    ("caching", [
        (r"from ['\"]ioredis['\"]|from ['\"]redis['\"]|require\(['\"]redis['\"]\)", "", "Redis client import"),
        (r"\b(redis|cache)\.(get|set|del|hget|hset|expire)\s*\(", "", "cache get/set operation"),
        (r"\bCache-Control\b|\bETag\b|no-cache|max-age=", "", "HTTP cache header"),
        (r"unstable_cache|revalidate:\s*\d+", "", "Next.js caching API"),
        (r"from ['\"]node-cache['\"]|from ['\"]lru-cache['\"]", "", "in-memory cache import"),
    ]),
    ("middleware", [
        (r"\(req\s*,\s*res\s*,\s*next\s*\)", "", "Express-style middleware (req,res,next)"),
        (r"NextResponse\.next\s*\(|NextResponse\.redirect\s*\(", "", "Next.js middleware response"),
        (r"app\.use\s*\(", "", "app.use() middleware registration"),
        (r"export\s+(default\s+)?function\s+middleware\s*\(", "", "middleware function export"),
    ]),
    ("async-boundary", [
        (r"\basync\s+function|\basync\s+\(", "", "async function declaration"),
        (r"\bawait\s+\w", "", "await expression"),
        (r"\.then\s*\(|\.catch\s*\(|\.finally\s*\(", "", "Promise chain"),
        (r"new Promise\s*\(", "", "explicit Promise construction"),
        (r"\bsetTimeout\b|\bsetInterval\b", "", "timer async boundary"),
    ]),
    ("api-call", [
        (r"\bfetch\s*\(['\"]https?:\/\/", "", "fetch() external URL call"),
        (r"\baxios\.(get|post|put|delete|patch)\s*\(", "", "axios request"),
        (r"from ['\"]axios['\"]|require\(['\"]axios['\"]\)", "", "axios import"),
        (r"\bnew XMLHttpRequest\s*\(", "", "XMLHttpRequest usage"),
        (r"\bgot\.(get|post)|superagent\.", "", "got/superagent HTTP client"),
    ]),
    ("state-management", [
        (r"\buseState\s*\(|useReducer\s*\(", "", "React local state"),
        (r"\bcreateSlice\s*\(|configureStore\s*\(", "", "Redux Toolkit store"),
        (r"\buseDispatch\s*\(\)|useSelector\s*\(", "", "Redux hooks"),
        (r"\batom\s*\(|useAtom\s*\(", "", "Jotai/Recoil atom"),
        (r"\bcreate\s*\(\s*\(\s*set\s*\)", "", "Zustand store"),
        (r"createContext\s*\(|useContext\s*\(", "", "React Context state"),
    ]),
    ("env-variable", [
        (r"process\.env\.\w+", "", "process.env access"),
        (r"import\.meta\.env\.\w+", "", "import.meta.env (Vite) access"),
        (r"\benv\(\s*['\"][A-Z_]+['\"]\s*\)", "", "env() function call"),
        (r"process\.env\[['\"][A-Z_]+['\"]\]", "", "process.env bracket access"),
    ]),
    ("websocket", [
        (r"new WebSocket\s*\(", "", "WebSocket constructor"),
        (r"\bSocket\.io\b|from ['\"]socket\.io", "", "Socket.io import"),
        (r"\.on\s*\(\s*['\"]connect['\"]|\.on\s*\(\s*['\"]message['\"]", "", "WebSocket event listener"),
        (r"\bws\.send\s*\(|socket\.emit\s*\(", "", "WebSocket send/emit"),
    ]),
    ("filesystem-access", [
        (r"fs\.(readFile|writeFile|appendFile|unlink|mkdir|rmdir|stat)\s*\(", "", "fs read/write operation"),
        (r"from ['\"]fs\/promises['\"]|require\(['\"]fs\/promises['\"]\)", "", "fs/promises import"),
        (r"from ['\"]fs['\"]", "", "Node.js fs module import"),
        (r"path\.(join|resolve|dirname|basename)\s*\(", "", "path manipulation (fs hint)"),
    ]),
    ("error-handling", [
        (r"try\s*\{[\s\S]*?\}\s*catch\s*\(", "", "try/catch block"),
        (r"\.catch\s*\(\s*(err|error|e)\s*=>", "", "Promise .catch handler"),
        (r"\bErrorBoundary\b|\berrorBoundary\b", "", "React ErrorBoundary"),
        (r"throw\s+new\s+\w*Error\s*\(", "", "explicit error throw"),
    ]),
    ("logging", [
        (r"console\.(log|error|warn|info|debug)\s*\(", "", "console logging"),
        (r"\blogger\.(info|warn|error|debug)\s*\(", "", "logger.xxx() call"),
        (r"from ['\"]winston['\"]|from ['\"]pino['\"]", "", "logging library import"),
    ]),
    ("rate-limiting", [
        (r"from ['\"]express-rate-limit['\"]|from ['\"]@upstash\/ratelimit['\"]", "", "rate limit library import"),
        (r"\brateLimit\s*\(|\bratelimit\s*\(", "", "rate limit function call"),
        (r"\bX-RateLimit\b|Retry-After", "", "rate limit HTTP headers"),
    ]),
    ("cors", [
        (r"from ['\"]cors['\"]|require\(['\"]cors['\"]\)", "", "cors package import"),
        (r"Access-Control-Allow-Origin", "", "CORS response header"),
        (r"app\.use\s*\(\s*cors\s*\(", "", "cors middleware registration"),
    ]),
    ("encryption", [
        (r"from ['\"]crypto['\"]|require\(['\"]crypto['\"]\)", "", "Node.js crypto module"),
        (r"\bcrypto\.(createHash|createCipher|randomBytes|createSign)\s*\(", "", "crypto operation"),
        (r"from ['\"]bcrypt['\"]|from ['\"]argon2['\"]", "", "password hashing library"),
        (r"\bAES\b|\bRSA\b|CryptoSubtle", "", "crypto algorithm reference"),
    ]),
]

# Pattern whose first group is the dependency, flags, languages it is limited to (none: all).
DEPENDENCIES = [
    (r"\bimport\s+(?:type\s+)?(?:[\w*{},\s]+\s+from\s+)?['\"]([^'\"]+)['\"]", "", []),
    (r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "", []),
    (r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "", []),
    (r"^import\s+([\w.]+)(?:\s+as\s+\w+)?", "m", ["Python"]),
    (r"^from\s+([\w.]+)\s+import", "m", ["Python"]),
    (r"import\s+\"([^\"]+)\"", "", ["Go"]),
    (r"^\s+\"([^\"]+)\"\s*$", "m", ["Go"]),
    (r"^use\s+([\w:]+)", "m", ["Rust"]),
    (r"^import\s+([\w.]+);", "m", ["Java"]),
    (r"^using\s+([\w.]+);", "m", ["C#"]),
    (r"@import\s+['\"]([^'\"]+)['\"]", "", ["CSS", "SCSS", "Sass", "Less"]),
]
INTERNAL_PREFIXES = [".", "@/", "~/"]
