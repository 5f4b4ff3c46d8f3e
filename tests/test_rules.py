"""For every pattern of the rule tables, in order, a text that it must find, written by hand; prose that none of them may find."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.regex import Pattern, hits
from siltstone.operators.grounding import api_pattern
from siltstone.rules import artifact, framework, language, registry, runtime, signals

PROSE = ["The parcel came on Monday and nobody asked where it had been.", "zzz qqq", "Morgen wird das Wetter wieder schön; wir gehen an den See."]

SHEBANGS = ["#!/usr/bin/env python3", "#!/usr/bin/node", "#!/bin/bash", "#!/usr/bin/ruby -w", "#!/usr/bin/perl", "#!/usr/bin/php"]
LANGUAGES = [
    ["let a: string", "as const"], ["interface A"], ["import React from 'x'", "return ( <b>"], ["<Chip />"], ["const a = 1", "module.exports = a"], ["require(x)"],
    ["def go(", "from a import b"], ["lambda x"], ["package shop", "func Pay"], ["defer done"], ["let mut a", "pub struct A"], ["unwrap()a"],
    ["private A", "import java.util"], ["new Shop(a"], ["namespace Shop", "public enum A"], ["using System"], ["  insert into t"], ["drop table t"],
    ["export A=1", "echo ${HOME}"], ["curl x"], ["name: build", "  - lint"], ["---"], ["  [1"], ['"a": 1'], ["<!doctype html>"], ["<div >"],
    [".card { color: red }", "@media print"], ["{ a: b; }"], ["## Title", "[a](b)"], ["- item"], ["query Shop"], ["Mutation"],
]
FRAMEWORKS = [
    ["from 'next/link'", '"use client"', "export async function GET (", "export const metadata =", "NextResponse", "generateStaticParams(", "getStaticPaths"],
    ["from 'react'", "useMemo(", "<Chip", "React.forwardRef("], ['require("express")', "Router( )", "app.delete(", "express()"],
    ["from '@nestjs/common'", "@Injectable(", "@Module (", "InjectRepository("], ["from '@prisma/client'", "new PrismaClient (", "prisma.user.upsert(", "prisma.$transaction("],
    ["defineComponent(", "from 'vue'", "<script  setup", "reactive("], ["import fastapi", "@app.patch(", "Depends("],
]
RUNTIMES = [
    ["export const runtime = 'edge'", "EdgeRuntime", "from '@cloudflare/workers-types'", "addEventListener('fetch'", "env: Env"],
    ["module.exports.handler =", "APIGatewayProxyResult", "from '@aws-sdk/s3'", "event.Records", "VercelResponse"],
    ["process.argv", "require('readline')", "from 'yargs'", "process.stderr", "console.error("],
    ["document.body", "sessionStorage.x", "navigator.x", "addEventListener(", "location.hash", "XMLHttpRequest", "'use client'"],
    ["require('fs')", "from 'path'", "require('child_process')", "from 'os'", "from 'crypto'", "require('stream')", "from 'https'", "process.env.A", 'require("', "__filename"],
    ["(req, res, next)", "NextResponse.next(", "export default function middleware(", "export const config = { matcher", "async function middleware("],
]
ROLES = [
    (["a.spec.tsx", "__tests__/a"], ["beforeEach(", "expect(", "from 'vitest'", "jest.mock("]), (["Badge.tsx"], ["export default function Badge(", "return ( <b", "JSX.Element", "useRef(", "interface AProps {", "<Chip>"]),
    (["useA.ts"], ["export function useAb(", "useReducer(", "return { a }"]), (["My-Context.tsx"], ["createContext(", "Provider x value = {", "export const useAuthContext =", "ContextType"]),
    (["route.ts"], ["export async function PATCH(", "export function handler(", "NextRequest", "Response.json(", "res.status("]), (["Middleware.js"], ["export function middleware(", "NextResponse.redirect(", "(req,res,next)", "export const config = {matcher"]),
    (["jwt.ts"], ["bcrypt", "authenticate(", "bearerToken", "from '@auth/core'", "NextAuth("]), (["a.schema.ts", "a.model.js", "types.ts"], ["z.enum(", "type A = {", "interface A {", "enum A {", "export type A"]),
    (["repo.ts"], ["from '@prisma/client'", "mongoose.model", "findById(", "Sequelize", "new Schema({"]), (["slice.ts"], ["createStore(", "selector(", "create((set)", "useSelector"]),
    (["a.service.ts"], ["@Injectable()", "export class CatService", "Repository<Cat>"]), (["a.config.js", "vite.x"], ["export default {", "defineConfig(", "A_B = 1"]), (["utils.ts"], ["export const a", "export { a }"]),
]
SIGNALS = [
    ["argon2", "useSession(", "refreshToken", 'from "next-auth', "hashPassword("], ["from '@prisma/client'", "mongoose.connect", "from 'mysql2'", "insertOne(", "Knex", ".transaction("],
    ["from 'ioredis'", "cache.expire(", "no-cache", "revalidate: 60", "from 'lru-cache'"], ["(req, res, next)", "NextResponse.next(", "app.use(", "export default function middleware("],
    ["async function", "await x", ".finally(", "new Promise(", "setInterval"], ["fetch('https://a", "axios.patch(", "require('axios')", "new XMLHttpRequest(", "superagent."],
    ["useReducer(", "configureStore(", "useSelector(", "useAtom(", "create( ( set )", "useContext("], ["process.env.KEY", "import.meta.env.KEY", "env('KEY')", "process.env['KEY']"],
    ["new WebSocket(", "from 'socket.io", ".on('message'", "socket.emit("], ["fs.rmdir(", "require('fs/promises')", "from 'fs'", "path.basename("],
    ["try { a } catch (", ".catch(err =>", "ErrorBoundary", "throw new TypeError("], ["console.debug(", "logger.warn(", "from 'pino'"],
    ["from 'express-rate-limit'", "ratelimit(", "Retry-After"], ["require('cors')", "Access-Control-Allow-Origin", "app.use( cors("], ["require('crypto')", "crypto.randomBytes(", "from 'argon2'", "RSA"],
]
BRACKETS = [
    ["useFormStatus(", "from 'react' x use", "React.use("], ["startTransition(", "useInsertionEffect(", "hydrateRoot(", "Suspense a fallback", "Concurrently"], ["useCallback(", "React.createContext(", "React.memo("],
    ["'use cache'", "cacheTag(", "after(", "connection( )"], ["'use server'", "export async function DELETE(", "export const metadata =", "NextRequest", 'from "next/server"', "generateStaticParams(", "notFound()"],
    ["getStaticProps", "from 'next/router'", "from 'next/link'", "from 'next/image'"], ["app.listen( await", "express() Promise"], ["require('express')", "Router()", "app.put("],
    ["prisma.$transaction([", "PrismaClientKnownRequestError", "typedSql", "relationLoadStrategy"], ["new PrismaClient(", "prisma.a.create("], ["setup(", "watch(", "from 'vue' onMounted", "<script setup"],
    ["new Vue(", "data() { return {", "mounted() {"], ["from '@nestjs/core'", "@Controller(", "ModuleRef"], ["from fastapi import FastAPI", "@app.get(", "Annotated["],
]
APIS = [
    "useTransition (", "startTransition(", "useId(", "useDeferredValue(", "useInsertionEffect(", "createRoot(", "use(", "useOptimistic(", "ReactDOM.render(", "'use client'", '"use server"', "generateStaticParams(",
    "export const metadata", '"export const runtime = "edge"', "getServerSideProps(", "'use cache'", "express.Router(", "express.json(", "app.listen(", "prisma.$extends(", "prisma.$transaction([])", "prisma.findUniqueOrThrow(",
    "typedSql", "defineComponent(", "<script setup>", "ref(", "new Vue(", "@Injectable(", "@Controller(", "@Module(", "InjectRepository(", "Annotated[type, Depends (]", "@app.get( / @app.post(", "APIRouter(",
]


def pairs():
    """(table, pattern, text) of every rule table; a table and its texts have the same shape."""
    flat = lambda groups: [x for g in groups for x in g]
    yield "shebangs", [Pattern(p) for p, _ in language.SHEBANGS], SHEBANGS
    yield "languages", [Pattern(*p) for _, _, strong, weak in language.HEURISTICS for p in strong + weak], flat(LANGUAGES)
    yield "frameworks", [Pattern(p) for r in framework.RULES for p, _ in r[4]], flat(FRAMEWORKS)
    yield "runtimes", [Pattern(p) for r in runtime.RULES for p, _ in r[4]], flat(RUNTIMES)
    yield "names", [Pattern(*p) for r in artifact.RULES for p in r[4]], flat(n for n, _ in ROLES)
    yield "roles", [Pattern(*p) for r in artifact.RULES for p in r[5]], flat(t for _, t in ROLES)
    yield "signals", [Pattern(p, f) for _, rows in signals.RULES for p, f, _ in rows], flat(SIGNALS)
    yield "brackets", [Pattern(*p) for b in registry.BRACKETS for p in b[5]], flat(BRACKETS)
    yield "apis", [api_pattern(a[1]) for a in registry.APIS], APIS


TABLES = {name: (patterns, texts) for name, patterns, texts in pairs()}


def test_every_pattern_has_a_text():
    assert {name: len(p) for name, (p, _) in TABLES.items()} == {name: len(t) for name, (_, t) in TABLES.items()}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_patterns_find_their_texts(spark, name):
    patterns, texts = TABLES[name]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *PROSE])], "i int, t string").select("i", hits(F.col("t"), patterns).alias("h")).collect()
    found = {r.i: set(r.h) for r in rows}
    assert [texts[i] for i in range(len(texts)) if i not in found[i]] == []
    assert [found[len(texts) + i] for i in range(len(PROSE))] == [set()] * len(PROSE)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_the_other_dialect_agrees(name):
    import duckdb

    patterns, texts = TABLES[name]
    con = duckdb.connect()
    missed = [t for p, t in zip(patterns, texts, strict=True) if not con.execute("SELECT regexp_matches(?, ?)", [t, p.re2]).fetchone()[0]]
    assert missed == []
