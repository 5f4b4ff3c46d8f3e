"""Framework rules."""

SAMPLE = 3000
NEXT_ROUTE_FILES = ["page.tsx", "page.ts", "route.ts", "layout.tsx"]
NEXT_ROUTE_BONUS, NEXT_ROUTE_CAP = 0.10, 0.97

# Name, base, step, maximum, [(pattern, label)].
RULES = [
    ("Next.js", 0.70, 0.08, 0.97, [
        (r"from ['\"]next\/", "next/* import"),
        (r"['\"]use client['\"]|['\"]use server['\"]", '"use client"/"use server" directive'),
        (r"export\s+(default\s+)?async\s+function\s+(GET|POST|PUT|DELETE|PATCH)\s*\(", "App Router route handler"),
        (r"export\s+const\s+metadata\s*=", "Next.js metadata export"),
        (r"NextRequest|NextResponse", "NextRequest/NextResponse types"),
        (r"generateStaticParams\s*\(", "generateStaticParams()"),
        (r"getServerSideProps|getStaticProps|getStaticPaths", "Pages Router data fetcher"),
    ]),
    ("React", 0.60, 0.07, 0.95, [
        (r"from ['\"]react['\"]", "react import"),
        (r"\buseState\s*\(|\buseEffect\s*\(|\buseCallback\s*\(|\buseMemo\s*\(", "React hooks"),
        (r"React\.createElement\s*\(|<[A-Z][A-Za-z]+", "JSX/React.createElement"),
        (r"\bReact\.memo\s*\(|React\.forwardRef\s*\(", "React.memo/forwardRef"),
    ]),
    ("Express", 0.65, 0.08, 0.95, [
        (r"require\s*\(\s*['\"]express['\"]\s*\)|from ['\"]express['\"]", "express import"),
        (r"\bRouter\s*\(\s*\)", "express Router()"),
        (r"app\.(get|post|put|delete|use)\s*\(", "app.METHOD() route"),
        (r"\bexpress\s*\(\s*\)", "express() app init"),
    ]),
    ("NestJS", 0.70, 0.08, 0.97, [
        (r"from ['\"]@nestjs\/core['\"]|from ['\"]@nestjs\/common['\"]", "@nestjs import"),
        (r"@Controller\s*\(|@Injectable\s*\(", "@Controller/@Injectable decorator"),
        (r"@Module\s*\(", "@Module decorator"),
        (r"InjectRepository\s*\(", "InjectRepository()"),
    ]),
    ("Prisma", 0.70, 0.08, 0.97, [
        (r"from ['\"]@prisma\/client['\"]", "@prisma/client import"),
        (r"new PrismaClient\s*\(", "new PrismaClient()"),
        (r"prisma\.\w+\.(findMany|findFirst|create|update|upsert|delete)\s*\(", "Prisma query method"),
        (r"prisma\.\$transaction\s*\(", "prisma.$transaction()"),
    ]),
    ("Vue", 0.65, 0.08, 0.97, [
        (r"\bdefineComponent\s*\(|\bsetup\s*\(", "Vue Composition API"),
        (r"from ['\"]vue['\"]", "vue import"),
        (r"<script\s+setup", "<script setup>"),
        (r"\bref\s*\(|\breactive\s*\(|\bcomputed\s*\(", "Vue reactivity primitives"),
    ]),
    ("FastAPI", 0.70, 0.08, 0.97, [
        (r"from fastapi import FastAPI|import fastapi", "fastapi import"),
        (r"@app\.(get|post|put|delete|patch)\s*\(", "FastAPI route decorator"),
        (r"\bDepends\s*\(", "FastAPI Depends()"),
    ]),
]
