"""Runtime rules."""

SAMPLE = 3000
LABELS = [("browser", "Browser"), ("node", "Node.js"), ("edge", "Edge"), ("serverless", "Serverless"), ("cli", "CLI"), ("middleware", "Middleware")]

# Runtime, file name contains / ends with, bonus, cap before the rule's own maximum.
FILENAME_BONUS = [("middleware", "contains", "middleware", 0.10), ("node", "ends", ".cjs", 0.05), ("serverless", "contains", "lambda", 0.08), ("serverless", "contains", "handler", 0.08)]
BONUS_CAP = 0.95

# Name, base, step, maximum, [(pattern, label)].
RULES = [
    ("edge", 0.78, 0.07, 0.97, [
        (r"export\s+const\s+runtime\s*=\s*['\"]edge['\"]", "edge runtime declaration"),
        (r"\bEdgeRuntime\b", "EdgeRuntime global"),
        (r"from ['\"]@cloudflare\/workers-types['\"]", "Cloudflare Workers types"),
        (r"addEventListener\s*\(\s*['\"]fetch['\"]", "Cloudflare fetch listener"),
        (r"\bExecutionContext\b|\benv:\s*Env\b", "Cloudflare Worker context"),
    ]),
    ("serverless", 0.75, 0.07, 0.95, [
        (r"exports\.handler\s*=|module\.exports\.handler\s*=", "Lambda handler export"),
        (r"\bAWSLambda\b|\bAPIGatewayProxyEvent\b|\bAPIGatewayProxyResult\b", "AWS Lambda types"),
        (r"from ['\"]@aws-sdk\/", "AWS SDK import"),
        (r"context\.awsRequestId|event\.Records", "Lambda event/context usage"),
        (r"\bVercelRequest\b|\bVercelResponse\b", "Vercel serverless types"),
    ]),
    ("cli", 0.74, 0.07, 0.94, [
        (r"process\.argv\b", "process.argv"),
        (r"from ['\"]readline['\"]|require\(['\"]readline['\"]\)", "readline import"),
        (r"from ['\"]commander['\"]|from ['\"]yargs['\"]", "CLI framework import"),
        (r"process\.stdin|process\.stdout|process\.stderr", "process stdio"),
        (r"\bconsole\.log\s*\(|console\.error\s*\(", "console output (CLI pattern)"),
    ]),
    ("browser", 0.72, 0.07, 0.96, [
        (r"\bwindow\s*\.\w+|\bdocument\s*\.\w+", "window/document access"),
        (r"\blocalStorage\s*\.\w+|\bsessionStorage\s*\.\w+", "localStorage/sessionStorage"),
        (r"\bnavigator\s*\.\w+", "navigator API"),
        (r"\baddEventListener\s*\(", "addEventListener (DOM)"),
        (r"\blocation\s*\.(href|pathname|search|hash)\b", "window.location"),
        (r"\bfetch\s*\(|XMLHttpRequest", "fetch/XHR (browser common)"),
        (r"['\"]use client['\"]", "use client directive"),
    ]),
    ("node", 0.70, 0.07, 0.95, [
        (r"from ['\"]fs['\"]|require\(['\"]fs['\"]\)", "fs import"),
        (r"from ['\"]path['\"]|require\(['\"]path['\"]\)", "path import"),
        (r"from ['\"]child_process['\"]|require\(['\"]child_process['\"]\)", "child_process import"),
        (r"from ['\"]os['\"]|require\(['\"]os['\"]\)", "os import"),
        (r"from ['\"]crypto['\"]|require\(['\"]crypto['\"]\)", "crypto import"),
        (r"from ['\"]stream['\"]|require\(['\"]stream['\"]\)", "stream import"),
        (r"from ['\"]http['\"]|from ['\"]https['\"]", "http/https module"),
        (r"process\.env\.\w+", "process.env access"),
        (r"require\s*\(\s*['\"]", "CommonJS require"),
        (r"__dirname|__filename", "__dirname / __filename"),
    ]),
    ("middleware", 0.65, 0.08, 0.90, [
        (r"\(req\s*,\s*res\s*,\s*next\s*\)", "Express middleware signature (req,res,next)"),
        (r"\bNextResponse\.next\s*\(", "NextResponse.next() middleware call"),
        (r"export\s+(default\s+)?function\s+middleware\s*\(", "Next.js middleware export"),
        (r"export\s+const\s+config\s*=\s*\{\s*matcher", "Next.js middleware matcher config"),
        (r"\basync\s+function\s+middleware\s*\(", "async middleware function"),
    ]),
]
