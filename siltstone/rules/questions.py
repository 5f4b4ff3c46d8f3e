"""Confidence weights, thresholds and questions."""

WEIGHTS = [("language", 0.35), ("framework", 0.25), ("runtime", 0.20), ("artifact", 0.20)]
ABSENT, CLARIFY_BELOW, MOST = 0.35, 0.65, 3

# Priority, question, reason.
QUESTIONS = [
    (1, "What programming language is this code written in?", "The language could not be determined with certainty from the file content."),
    (2, "Is this file part of a specific framework project (e.g. Next.js, Express, Django)?", "No clear framework signals were found. This helps tailor the analysis to your stack."),
    (3, "Is this code intended to run in the browser, on the server (Node.js), or at the edge?", "The runtime environment is ambiguous, which affects how authentication, storage, and APIs should be analysed."),
    (4, "Is authentication handled in this file, or is it delegated to middleware/another service?", "Authentication patterns were detected, but the scope is unclear. This is important for security analysis."),
    (5, "What database or ORM is used in this project (e.g. Prisma, Mongoose, raw SQL)?", "Database access patterns were found but the ORM/driver could not be confirmed. This matters for scalability and security review."),
    (6, "What is the intended role of this file (e.g. API route, component, utility, database model)?", "The file's architectural role could not be determined with confidence, which affects how it is reviewed."),
    (7, "Is this file part of a larger project, and if so, what is its main purpose?", "Overall confidence is low without broader project context. Additional context significantly improves analysis quality."),
]

# Threshold, most questions, and the templates; {label} is the version label.
VERSION_BELOW, VERSION_MOST = 0.60, 2
VERSION_QUESTIONS = [
    ("React", "Is this React {label} code, or a different version?"),
    ("Next.js", "Which Next.js version and routing model is this project using (e.g. Next.js 14 App Router)?"),
    ("Vue", "Which version of Vue is this project using (Vue 2 or Vue 3)?"),
    ("Express", "Which version of Express is this project using (Express 4 or Express 5)?"),
    ("Angular", "Which version of Angular is this project using (e.g. Angular 16, 17)?"),
    ("NestJS", "Which version of NestJS is this project using (e.g. NestJS 9, 10)?"),
    ("Prisma", "Is this Prisma {label} code?"),
    ("FastAPI", "Which version of FastAPI is this project using (e.g. FastAPI 0.100+)?"),
]
# Questions of a label that names a variant (framework, text in the label, question).
VERSION_VARIANTS = [
    ("Next.js", "App Router", "Is this Next.js App Router (13+) code, or Pages Router?"),
    ("Vue", "3", "Is this Vue 3 Composition API or Vue 2 Options API?"),
]
