"""Messages and prompt texts; names in braces stand for what is filled in."""

# Validation messages.
TOO_LARGE = "{what} is too large ({size}MB). Maximum allowed size is {limit}MB."
MULTIMEDIA = "Multimedia files (images, videos, audio) are not supported. Please upload code files."
UNSUPPORTED = "File type not supported ({extension}). Only JavaScript, TypeScript, Vue, and Svelte files are supported."
UNREADABLE = "Could not read file: {name}"
NOT_CODE = "Pasted content was not recognised as valid JavaScript, TypeScript, Vue, or Svelte code."

# The block about a finding that goes before a chat, and its parts.
FINDING_CONTEXT = """[FINDING CONTEXT — for reference only]
ID: {id}
Title: {title}
Category: {category} | Severity: {severity}
Explanation: {explanation}
Recommendation: {recommendation}
Evidence lines:
{evidence}{snippet}

The developer is asking a follow-up question about this finding. Answer it directly."""
NO_EVIDENCE = "  - (no specific evidence lines provided)"
SNIPPET = "\n[RELEVANT CODE SNIPPET]\n```\n{snippet}\n```"
BEFORE_TURN = "{block}\n\n---\n\n"

# The context of a review.
UNDERSTANDING = """[DETERMINISTIC UNDERSTANDING]
Summary: {summary}
Framework: {framework}
Runtime: {runtime}
Artifact Type: {artifact}
Dependencies: {dependencies}

[ARCHITECTURAL SIGNALS]
{signals}

[VERSION GROUNDING]
Inferred Versions:
{versions}

Detected API Patterns:
{apis}

Recommended Grounding Sources (for reference context):
{sources}"""
TASK = "comprehensive code review"
INSISTED = 'CRITICAL INSTRUCTION FROM USER: Ignore previous detected context. The user explicitly states: "{correction}". \n\nAdditional instructions: {task}'
TASK_LINE = "Perform a structured {task} on the following code artifact."

# What the confirmation card shows when nothing was found or asked.
NO_FRAMEWORKS, NO_SIGNALS, NO_PROMPT = "None detected", "Standard", "(No extra context provided)"
