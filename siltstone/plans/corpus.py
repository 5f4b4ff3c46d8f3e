"""A derived corpus of source texts: our own snippets dealt over the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPETS = [
    ("orders.route.ts", "import { NextRequest, NextResponse } from 'next/server';\nimport { PrismaClient } from '@prisma/client';\nimport { z } from \"zod\";\nconst prisma = new PrismaClient();\nexport async function GET(req: NextRequest) {\n  const rows = await prisma.order.findMany({ take: 5 });\n  return NextResponse.json(rows);\n}\nexport async function POST(req: NextRequest) {\n  try { await getServerSession(); } catch (e) { throw new Error('no'); }\n}\n"),
    ("Badge.tsx", "import React, { useState } from 'react';\ninterface BadgeProps { label: string; count: number }\nexport default function Badge(props: BadgeProps) {\n  const [on, setOn] = useState(false);\n  return (\n    <Chip onClick={() => setOn(!on)}>{props.label}</Chip>\n  );\n}\n"),
    ("useTicker.ts", "import { useEffect, useId, useTransition } from 'react';\nexport function useTicker(ms: number) {\n  const id = useId();\n  const [busy, startTransition] = useTransition();\n  useEffect(() => { const t = setInterval(() => startTransition(() => {}), ms); return () => clearInterval(t); }, [ms]);\n  return { id, busy };\n}\n"),
    ("server.js", "const express = require('express');\nconst cors = require('cors');\nconst app = express();\napp.use(cors());\napp.get('/items', (req, res, next) => { res.json([]); });\napp.listen(3000);\nmodule.exports = app;\n"),
    ("cats.service.ts", "import { Injectable, Module, Controller } from '@nestjs/common';\nimport { ModuleRef } from '@nestjs/core';\n@Injectable()\nexport class CatsService {\n  constructor(private readonly ref: ModuleRef) {}\n  async all() { return this.repo.query('select 1'); }\n}\n"),
    ("main.py", "#!/usr/bin/env python3\nimport os\nimport numpy as np\nfrom fastapi import FastAPI, Depends\napp = FastAPI()\n@app.get('/ping')\ndef ping(user=Depends(os.getpid)):\n    return {'ok': True}\n"),
    (None, "#!/usr/bin/env bash\nset -e\nexport MODE=fast\necho \"$MODE\" | grep fast\n"),
    (None, "#!/usr/bin/env node\nconst args = process.argv.slice(2);\nconsole.log(args);\n"),
    ("lambda_handler.js", "const { S3 } = require('aws');\nexports.handler = async (event, context) => {\n  const n = event.Records.length;\n  console.error(context.awsRequestId, n);\n};\n"),
    ("middleware.ts", "import { NextResponse } from 'next/server';\nexport function middleware(req) {\n  return NextResponse.next();\n}\nexport const config = { matcher: ['/a'] };\n"),
    ("edge.ts", "export const runtime = 'edge';\nexport default async function handler(request: Request): Promise<Response> {\n  addEventListener('fetch', () => {});\n  return new Response('ok');\n}\n"),
    ("cart.store.ts", "import { create } from 'zustand';\nexport const useCart = create((set) => ({ items: [], add: (i: string) => set({ items: [i] }) }));\n"),
    ("ThemeContext.tsx", "import React, { createContext, useContext } from 'react';\nconst Theme = React.createContext('light');\nexport const useThemeContext = () => useContext(Theme);\nexport function ThemeProvider({ children }) { return (<Theme.Provider value={{ a: 1 }}>{children}</Theme.Provider>); }\n"),
    ("user.schema.ts", "import { z } from 'zod';\nexport type User = { id: string };\nexport interface Named { name: string }\nexport enum Kind { A, B }\nexport const S = z.object({ id: z.string() });\n"),
    ("mathUtils.ts", "export const add = (a: number, b: number): number => a + b;\nexport function mul(a: number, b: number) { return a * b; }\nexport { add as plus };\n"),
    ("adder.test.ts", "import { describe, it, expect, vi } from 'vitest';\nimport { add } from './mathUtils';\ndescribe('add', () => { it('adds', () => { const f = vi.fn(); expect(add(1, 2)).toBe(3); }); });\n"),
    ("models.js", "import mongoose from 'mongoose';\nconst Pet = mongoose.model('Pet', new Schema({ name: String }));\nawait Pet.findById(1);\nReactDOM.render(x, y);\n"),
    ("client.ts", "import { createTRPCClient } from '@trpc/client';\nimport axios from 'axios';\nexport const api = axios.create({});\napi.get('x').then((r) => r).catch((err) => null);\nconst socket = new WebSocket('wss://h');\nsocket.emit('a');\n"),
    ("Counter.vue", "<script setup>\nimport { ref, computed } from 'vue'\nconst n = ref(0)\nconst d = computed(() => n.value * 2)\n</script>\n<template><b>{{ d }}</b></template>\n"),
    ("legacy.js", "var app = new Vue({ data() { return { a: 1 } }, mounted() { fetch('https://h/x'); } });\nlocalStorage.setItem('k', window.location.href);\n"),
    ("main.go", "package main\nimport (\n  \"fmt\"\n  \"net/http\"\n)\nfunc main() { fmt.Println(http.StatusOK) }\n"),
    (None, "package shop\nimport \"errors\"\nfunc Pay() error { defer done(); return errors.New(\"x\") }\n"),
    ("lib.rs", "use std::collections::HashMap;\nuse serde::Serialize;\n#[derive(Serialize)]\npub struct A { m: HashMap<u8, u8> }\nimpl A { pub fn n(&self) -> usize { self.m.len() } }\n"),
    ("Shop.java", "package shop;\nimport java.util.List;\nimport java.io.File;\npublic class Shop { private List<String> all; @Override public String toString() { return \"\"; } }\n"),
    ("Shop.cs", "using System;\nusing System.Text;\nnamespace Shop { public class Till { private int n; } }\n"),
    ("top.sql", "SELECT id, name FROM users WHERE id = 1;\nUPDATE users SET name = 'x';\n"),
    ("site.scss", "@import 'theme';\n.card { color: red; margin: 0; }\n@media print { .card { display: none; } }\n"),
    ("Dockerfile", "FROM node:20\nRUN npm ci\n"),
    (None, "name: build\njobs:\n  - lint\n  - test\n"),
    (None, "{\"name\": \"x\", \"deps\": {\"a\": \"1\"}}\n"),
    (None, "<!DOCTYPE html>\n<html><body><p>hi</p></body></html>\n"),
    (None, "Just a note to say the parcel came on time. cafépublic class and naïvetest( here.\n"),
    ("auth.ts", "import NextAuth, { AuthOptions } from 'next-auth';\nimport jwt from 'jsonwebtoken';\nimport crypto from 'crypto';\nexport const authOptions: AuthOptions = {};\nconst accessToken = jwt.sign({}, process.env.SECRET);\nexport default NextAuth(authOptions);\nconst h = crypto.createHash('sha256');\n"),
    ("page.tsx", "'use client';\nimport Link from 'next/link';\nimport { useRouter } from 'next/router';\nexport const metadata = { title: 'Shop' };\nexport default function Page() { return (<Link href=\"/\">home</Link>); }\n"),
    ("next.config.js", "module.exports = { reactStrictMode: true };\n"),
    ("cache.ts", "import Redis from 'ioredis';\nimport { Ratelimit } from '@upstash/ratelimit';\nconst redis = new Redis();\nawait redis.set('k', 1);\nexport async function get(k: string) { logger.info('x'); return unstable_cache(k); }\nreadFile(path.join(__dirname, 'a'));\n"),
    ("api/login.ts", "export default function handler(req, res) { login(req.body); res.status(200).json({ ok: true }); }\n"),
    ("", ""),
]


def spread(df: DataFrame) -> DataFrame:
    """Rows that are read in fewer parts than there are cores, dealt over all cores before heavy work in the row; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_id, filename, content): one artifact for each part. The snippet table is fixed and small."""
    rows = spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(SNIPPETS)], "snippet_id int, filename string, content string")
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")).select(F.col("p_partkey").alias("artifact_id"), F.pmod("p_partkey", F.lit(len(SNIPPETS))).cast("int").alias("snippet_id"))
    return part.join(F.broadcast(rows), "snippet_id").select("artifact_id", "filename", "content")
