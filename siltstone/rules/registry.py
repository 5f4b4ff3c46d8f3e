"""Framework versions, their indicators, APIs and documentation."""

# Framework, label, least version, greatest version, boost, indicators (pattern, flags). Order is tie-break order.
BRACKETS = [
    ("React", "React 19.x", "19.0", None, 0.10, [(r"\buse\s*\(|useOptimistic\s*\(|useFormStatus\s*\(", ""), (r"""from ['"]react['"].*\buse\b""", ""), (r"React\.use\s*\(", "")]),
    ("React", "React 18.x", "18.0", "18.x", 0.12, [(r"\buseTransition\s*\(|\bstartTransition\s*\(", ""), (r"\buseId\s*\(|\buseDeferredValue\s*\(|\buseInsertionEffect\s*\(", ""), (r"\bcreateRoot\s*\(|hydrateRoot\s*\(", ""), (r"\bSuspense\b.*\bfallback", ""), (r"\bconcurrent", "i")]),
    ("React", "React 16–17.x", "16.8", "17.x", 0.05, [(r"\buseState\s*\(|\buseEffect\s*\(|\buseCallback\s*\(|\buseMemo\s*\(", ""), (r"React\.createContext\s*\(", ""), (r"React\.memo\s*\(", "")]),
    ("Next.js", "Next.js 15.x", "15.0", None, 0.10, [(r"\buse\s+cache\b|'use cache'", ""), (r"cacheLife\s*\(|cacheTag\s*\(", ""), (r"after\s*\(", ""), (r"connection\s*\(\s*\)", "")]),
    ("Next.js", "Next.js 13–14.x (App Router)", "13.0", "14.x", 0.12, [(r"""['"']use client['"']|['"']use server['"']""", ""), (r"export\s+(default\s+)?async\s+function\s+(GET|POST|PUT|DELETE|PATCH)\s*\(", ""), (r"export\s+const\s+metadata\s*=", ""), (r"NextRequest|NextResponse", ""), (r"""from ['"]next\/server['"]""", ""), (r"generateStaticParams\s*\(", ""), (r"\bnotFound\s*\(\)|\bredirect\s*\(", "")]),
    ("Next.js", "Next.js 12.x (Pages Router)", "12.0", "12.x", 0.08, [(r"getServerSideProps|getStaticProps|getStaticPaths", ""), (r"""from ['"]next\/router['"]""", ""), (r"""from ['"]next\/link['"]""", ""), (r"""from ['"]next\/image['"]""", "")]),
    ("Express", "Express 5.x", "5.0", None, 0.10, [(r"\bapp\.listen\s*\(.*\bawait\b", ""), (r"express\s*\(\s*\).*\bPromise\b", "")]),
    ("Express", "Express 4.x", "4.0", "4.x", 0.08, [(r"""require\s*\(\s*['"]express['"]\s*\)""", ""), (r"\bRouter\s*\(\s*\)", ""), (r"app\.(get|post|put|delete|use)\s*\(", "")]),
    ("Prisma", "Prisma 5.x", "5.0", None, 0.10, [(r"prisma\.\$transaction\s*\(\s*\[", ""), (r"\bPrismaClientKnownRequestError\b", ""), (r"\btypedSql\b|\b\$extends\b", ""), (r"relationLoadStrategy", "")]),
    ("Prisma", "Prisma 4.x", "4.0", "4.x", 0.07, [(r"new PrismaClient\s*\(", ""), (r"prisma\.\w+\.(findMany|findFirst|create|update|upsert|delete)\s*\(", "")]),
    ("Vue", "Vue 3.x (Composition API)", "3.0", None, 0.12, [(r"\bdefineComponent\s*\(|\bsetup\s*\(", ""), (r"\bref\s*\(|\breactive\s*\(|\bcomputed\s*\(|\bwatch\s*\(", ""), (r"""from ['"]vue['"].*\b(ref|reactive|computed|onMounted)\b""", ""), (r"<script\s+setup", "")]),
    ("Vue", "Vue 2.x (Options API)", "2.0", "2.x", 0.07, [(r"\bVue\.extend\s*\(|\bnew Vue\s*\(", ""), (r"\bdata\s*\(\s*\)\s*\{[\s\S]*?\breturn\s*\{", ""), (r"\bmounted\s*\(\s*\)\s*\{", "")]),
    ("NestJS", "NestJS 10.x", "10.0", None, 0.08, [(r"""from ['"]@nestjs\/core['"]|from ['"]@nestjs\/common['"]""", ""), (r"@Controller\s*\(|@Injectable\s*\(", ""), (r"\bINJECT_MODULE\b|\bModuleRef\b", "")]),
    ("FastAPI", "FastAPI 0.100+", "0.100", None, 0.08, [(r"from fastapi import FastAPI|import fastapi", ""), (r"@app\.(get|post|put|delete|patch)\s*\(", ""), (r"\bAnnotated\[|\bDepends\s*\(", "")]),
]
BASE, STEP, MOST, UNKNOWN, UNDETERMINED, SIGNAL_CHARS, SUMMARY_LEAST = 0.55, 0.05, 0.95, 0.20, 0.30, 60, 0.40

# The order of the registry.
FRAMEWORKS = ["React", "Next.js", "Express", "Prisma", "Vue", "NestJS", "FastAPI"]

# Framework, API, introduced in, deprecated in, description.
APIS = [
    ("React", "useTransition()", "18.0", None, "Marks state updates as non-urgent (concurrent rendering)"),
    ("React", "startTransition()", "18.0", None, "Wraps updates that can be interrupted by urgent renders"),
    ("React", "useId()", "18.0", None, "Generates stable IDs for accessibility (SSR-safe)"),
    ("React", "useDeferredValue()", "18.0", None, "Defers re-rendering of non-critical UI"),
    ("React", "useInsertionEffect()", "18.0", None, "Fires before DOM mutations (CSS-in-JS use case)"),
    ("React", "createRoot()", "18.0", None, "Replaces ReactDOM.render() for concurrent mode"),
    ("React", "use()", "19.0", None, "Reads resources (Promises, Context) during render"),
    ("React", "useOptimistic()", "19.0", None, "Optimistic UI updates for async actions"),
    ("React", "ReactDOM.render()", "16.0", "18.0", "Legacy render API"),
    ("Next.js", '"use client"', "13.0", None, "Marks component tree as client-side (App Router)"),
    ("Next.js", '"use server"', "13.0", None, "Marks functions as Server Actions (App Router)"),
    ("Next.js", "generateStaticParams()", "13.0", None, "Static param generation (App Router equivalent of getStaticPaths)"),
    ("Next.js", "export const metadata", "13.2", None, "Metadata API for SEO (App Router)"),
    ("Next.js", 'export const runtime = "edge"', "12.2", None, "Enables Edge Runtime for route/middleware"),
    ("Next.js", "getServerSideProps()", "9.3", None, "Server-side rendering data fetcher (Pages Router)"),
    ("Next.js", '"use cache"', "15.0", None, "Next.js 15 fine-grained caching directive"),
    ("Express", "express.Router()", "4.0", None, "Modular route handler"),
    ("Express", "express.json()", "4.16", None, "Built-in JSON body parser (replaces body-parser)"),
    ("Express", "app.listen()", "4.0", None, "Start HTTP server"),
    ("Prisma", "prisma.$extends()", "4.7", None, "Client extensions for query customisation"),
    ("Prisma", "prisma.$transaction([])", "4.0", None, "Sequential batch transactions"),
    ("Prisma", "prisma.findUniqueOrThrow()", "4.0", None, "Throws instead of returning null"),
    ("Prisma", "typedSql", "5.19", None, "Type-safe raw SQL queries"),
    ("Vue", "defineComponent()", "3.0", None, "Type-safe component definition (Composition API)"),
    ("Vue", "<script setup>", "3.2", None, "Compile-time syntactic sugar for Composition API"),
    ("Vue", "ref()", "3.0", None, "Reactive reference primitive"),
    ("Vue", "new Vue()", "2.0", "3.0", "Legacy Vue 2 Options API constructor"),
    ("NestJS", "@Injectable()", "1.0", None, "Marks class as NestJS injectable provider"),
    ("NestJS", "@Controller()", "1.0", None, "Route handler class decorator"),
    ("NestJS", "@Module()", "1.0", None, "Defines a NestJS module"),
    ("NestJS", "InjectRepository()", "6.0", None, "TypeORM repository injection"),
    ("FastAPI", "Annotated[type, Depends()]", "0.95", None, "PEP 593 annotated dependency injection"),
    ("FastAPI", "@app.get() / @app.post()", "0.1", None, "Route decorator with automatic OpenAPI generation"),
    ("FastAPI", "APIRouter()", "0.42", None, "Modular route grouping"),
]

# Framework, version label (None: every version), priority, label, URL, purpose.
SOURCES = [
    ("React", "React 19.x", 1, "React 19 Release Blog", "https://react.dev/blog/2024/12/05/react-19", "React 19 new APIs and breaking changes"),
    ("React", "React 19.x", 1, "React 19 Upgrade Guide", "https://react.dev/blog/2024/04/25/react-19-upgrade-guide", "Migration from React 18 to 19"),
    ("React", "React 19.x", 2, "React 19 Canary Changelog", "https://react.dev/blog/2024/02/15/react-labs-what-we-have-been-working-on-february-2024", "Experimental features in React 19"),
    ("React", "React 18.x", 1, "React 18 Release Blog", "https://react.dev/blog/2022/03/29/react-v18", "React 18 concurrent features"),
    ("React", "React 18.x", 1, "React 18 APIs Reference", "https://react.dev/reference/react", "All React 18 hooks and APIs"),
    ("React", "React 18.x", 2, "Upgrading to React 18", "https://react.dev/blog/2022/03/08/react-18-upgrade-guide", "Migration guide"),
    ("React", "React 18.x", 3, "React Concurrent Mode", "https://react.dev/blog/2021/06/08/the-plan-for-react-18", "Concurrent rendering plan"),
    ("React", "React 16–17.x", 1, "React Hooks Reference", "https://react.dev/reference/react", "Core hooks introduced in React 16.8"),
    ("React", "React 16–17.x", 2, "Hooks FAQ", "https://react.dev/learn/reusing-logic-with-custom-hooks", "Custom hooks patterns"),
    ("React", None, 1, "React Documentation", "https://react.dev", "Official React reference and guides"),
    ("React", None, 1, "React Changelog", "https://github.com/facebook/react/blob/main/CHANGELOG.md", "Full React release history"),
    ("Next.js", "Next.js 15.x", 1, "Next.js 15 Release Notes", "https://nextjs.org/blog/next-15", "Next.js 15 new features"),
    ("Next.js", "Next.js 15.x", 1, "Next.js 15 Docs", "https://nextjs.org/docs", "Official Next.js 15 documentation"),
    ("Next.js", "Next.js 15.x", 2, "Next.js 15 Migration Guide", "https://nextjs.org/docs/app/building-your-application/upgrading/version-15", "Upgrading to Next.js 15"),
    ("Next.js", "Next.js 13–14.x (App Router)", 1, "Next.js App Router Docs", "https://nextjs.org/docs/app", "App Router overview and reference"),
    ("Next.js", "Next.js 13–14.x (App Router)", 1, "Server Components", "https://nextjs.org/docs/app/building-your-application/rendering/server-components", "React Server Components in Next.js"),
    ("Next.js", "Next.js 13–14.x (App Router)", 2, "Next.js 13 Migration", "https://nextjs.org/docs/app/building-your-application/upgrading/app-router-migration", "Pages → App Router migration"),
    ("Next.js", "Next.js 13–14.x (App Router)", 2, "Next.js Caching", "https://nextjs.org/docs/app/building-your-application/caching", "Caching behaviour in App Router"),
    ("Next.js", "Next.js 12.x (Pages Router)", 1, "Next.js Pages Router Docs", "https://nextjs.org/docs/pages", "Pages Router reference"),
    ("Next.js", "Next.js 12.x (Pages Router)", 1, "Data Fetching (Pages)", "https://nextjs.org/docs/pages/building-your-application/data-fetching", "getServerSideProps / getStaticProps"),
    ("Next.js", "Next.js 12.x (Pages Router)", 2, "Next.js 12 Changelog", "https://nextjs.org/blog/next-12", "Next.js 12 features"),
    ("Next.js", None, 1, "Next.js Documentation", "https://nextjs.org/docs", "Official Next.js docs"),
    ("Next.js", None, 1, "Next.js Changelog", "https://github.com/vercel/next.js/blob/canary/packages/next/CHANGELOG.md", "Full Next.js release history"),
    ("Express", "Express 5.x", 1, "Express 5 Migration Guide", "https://expressjs.com/en/guide/migrating-5.html", "Migrating from Express 4 to 5"),
    ("Express", "Express 5.x", 1, "Express 5 API Reference", "https://expressjs.com/en/5x/api.html", "Express 5 full API"),
    ("Express", "Express 4.x", 1, "Express 4 API Reference", "https://expressjs.com/en/4x/api.html", "Express 4 full API"),
    ("Express", "Express 4.x", 1, "Express Routing Guide", "https://expressjs.com/en/guide/routing.html", "Routing in Express"),
    ("Express", "Express 4.x", 2, "Express Security Best Practices", "https://expressjs.com/en/advanced/best-practice-security.html", "Security guidance for Express apps"),
    ("Express", None, 1, "Express.js Documentation", "https://expressjs.com/en/api.html", "Express API reference"),
    ("Express", None, 2, "Express Security Advisories", "https://expressjs.com/en/advanced/best-practice-security.html", "Security best practices"),
    ("Prisma", "Prisma 5.x", 1, "Prisma 5 Changelog", "https://www.prisma.io/blog/prisma-5-0-0-release", "Prisma 5 breaking changes and features"),
    ("Prisma", "Prisma 5.x", 1, "Prisma Client API", "https://www.prisma.io/docs/orm/reference/prisma-client-reference", "Prisma Client full API reference"),
    ("Prisma", "Prisma 5.x", 2, "Prisma Upgrade Guide (4→5)", "https://www.prisma.io/docs/orm/more/upgrade-guides/upgrading-versions/upgrading-to-prisma-5", "Migration from Prisma 4"),
    ("Prisma", "Prisma 4.x", 1, "Prisma Client API", "https://www.prisma.io/docs/orm/reference/prisma-client-reference", "Prisma Client full API reference"),
    ("Prisma", "Prisma 4.x", 1, "Prisma Schema Reference", "https://www.prisma.io/docs/orm/reference/prisma-schema-reference", "Prisma schema language reference"),
    ("Prisma", "Prisma 4.x", 2, "Prisma Security", "https://www.prisma.io/docs/orm/prisma-client/queries/filtering-and-sorting", "Safe querying with Prisma"),
    ("Prisma", None, 1, "Prisma Documentation", "https://www.prisma.io/docs", "Official Prisma ORM documentation"),
    ("Prisma", None, 1, "Prisma Changelog", "https://github.com/prisma/prisma/releases", "Prisma release history"),
    ("Vue", "Vue 3.x (Composition API)", 1, "Vue 3 Documentation", "https://vuejs.org/guide/introduction.html", "Official Vue 3 guide"),
    ("Vue", "Vue 3.x (Composition API)", 2, "Vue 3 Migration from Vue 2", "https://v3-migration.vuejs.org/", "Breaking changes from Vue 2"),
    ("Vue", "Vue 2.x (Options API)", 1, "Vue 2 Documentation", "https://v2.vuejs.org", "Vue 2 official docs (note: EOL)"),
    ("Vue", "Vue 2.x (Options API)", 2, "Vue 2 EOL Notice", "https://v2.vuejs.org/eol", "Vue 2 end-of-life information"),
    ("Vue", None, 1, "Vue.js Documentation", "https://vuejs.org", "Official Vue 3 documentation"),
    ("Vue", None, 1, "Vue Changelog", "https://github.com/vuejs/core/blob/main/CHANGELOG.md", "Vue 3 release history"),
    ("NestJS", "NestJS 10.x", 1, "NestJS Documentation", "https://docs.nestjs.com", "Official NestJS reference"),
    ("NestJS", "NestJS 10.x", 2, "NestJS Security", "https://docs.nestjs.com/security/authentication", "Auth and security in NestJS"),
    ("NestJS", None, 1, "NestJS Documentation", "https://docs.nestjs.com", "Official NestJS reference"),
    ("NestJS", None, 1, "NestJS Changelog", "https://github.com/nestjs/nest/releases", "NestJS release history"),
    ("FastAPI", "FastAPI 0.100+", 1, "FastAPI Documentation", "https://fastapi.tiangolo.com", "Official FastAPI docs"),
    ("FastAPI", "FastAPI 0.100+", 1, "FastAPI Changelog", "https://fastapi.tiangolo.com/release-notes/", "FastAPI release notes"),
    ("FastAPI", "FastAPI 0.100+", 2, "FastAPI Security", "https://fastapi.tiangolo.com/tutorial/security/", "Security patterns in FastAPI"),
    ("FastAPI", None, 1, "FastAPI Documentation", "https://fastapi.tiangolo.com", "Official FastAPI docs"),
]
# Dependency (exact, or a prefix ending in /), framework it stands for.
LIBRARIES = [("@prisma/client", "Prisma"), ("mongoose", "Mongoose"), ("@trpc/", "tRPC")]
NOTHING_TO_GROUND = "No frameworks detected — no grounding required"
