"""A Java corpus derived row by row from the ``documents`` table.

Every document becomes one file: its text as header comment, followed by one
of some class templates chosen by ``doc_id``.  The templates carry known
weaknesses, which makes the structural operators checkable at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A template with so many weak methods, more than any cap on snippets.
WEAK_METHODS = 40

TEMPLATES = [
    # 0 clean
    """public class C@ID@ {
    public int area(int w, int h) {
        return w * h;
    }
}
""",
    # 1 SQL built inside the call
    """public class C@ID@ {
    public ResultSet load(Statement st, String who) throws SQLException {
        return st.executeQuery("SELECT id FROM people WHERE nick='" + who + "'");
    }
}
""",
    # 2 SQL held by a variable; bound parameters stay clean
    """public class C@ID@ {
    public void purge(Statement st, String key) throws SQLException {
        String text = "DELETE FROM items_@ID@ WHERE k=" + key;
        st.executeUpdate(text);
    }
    public void safe(Connection c, String key) throws SQLException {
        PreparedStatement ps = c.prepareStatement("SELECT a FROM b WHERE k = ?");
        ps.setString(1, key);
        ps.executeQuery();
    }
}
""",
    # 3 secrets: field, placeholder, environment, too short
    """public class C@ID@ {
    private String apiKey = "k-@ID@-live";
    private String dbPassword = "changeme";
    private String userToken = System.getenv("TOKEN");
    public void open() {
        String vaultSecret = "abc";
        String note = "hello world";
    }
}
""",
    # 4 weak and strong algorithms
    """public class C@ID@ {
    public byte[] digest(byte[] in) throws Exception {
        MessageDigest md = MessageDigest.getInstance("sha-1");
        Cipher c = Cipher.getInstance("DESede/CBC/PKCS5Padding");
        MessageDigest ok = MessageDigest.getInstance("SHA-256");
        return md.digest(in);
    }
}
""",
    # 5 process execution
    """public class C@ID@ {
    public void run(String a) throws Exception {
        Runtime.getRuntime().exec("tool " + a);
        new ProcessBuilder("tool2 " + a).start();
        new ProcessBuilder("tool3", a).start();
    }
}
""",
    # 6 path built by concatenation
    """public class C@ID@ {
    public void put(String n) throws IOException {
        FileWriter w = new FileWriter("/data/" + n);
        File f = new File("/data/", n);
    }
}
""",
    # 7 catch blocks
    """public class C@ID@ {
    public void go() {
        try { step(); } catch (IOException e) { }
        try { step(); } catch (RuntimeException e) { /* ignored */ }
        try { step(); } catch (Error e) { log.warn("x", e); }
    }
}
""",
    # 8 loops
    """public class C@ID@ {
    public String join(List<String> xs) {
        String out = "";
        int n = 0;
        for (String x : xs) {
            out += x + ";";
            n += x.length();
        }
        while (n > 0) {
            out += "-";
            n -= 1;
        }
        do { out += "z"; n += 1; } while (n < 3);
        return out;
    }
}
""",
    # 9 managed resource
    """public class C@ID@ {
    public String first(String p) throws IOException {
        try (BufferedReader r = new BufferedReader(new FileReader(p))) {
            return r.readLine();
        }
    }
}
""",
    # 10 leaked resource
    """public class C@ID@ {
    public int peek(String p) throws IOException {
        Socket s = new Socket(p, 80);
        return s.getPort();
    }
}
""",
    # 11 null risk, seen by the text signature only
    """public class C@ID@ {
    public String pick(HttpServletRequest q) {
        String v = q.getParameter("id").trim();
        return v;
    }
}
""",
    # 12 two weaknesses, the most severe is scored
    """public class C@ID@ {
    public void mix(String who) throws Exception {
        String apiKey = "abc123xyz";
        Runtime.getRuntime().exec("ls " + who);
    }
}
""",
    # 13 nested method, scored twice, reported once
    """public class C@ID@ {
    public Runnable outer(HttpServletRequest q) {
        return new Runnable() {
            public void run() {
                q.getParameter("a").trim();
            }
        };
    }
}
""",
    # 14 constructor and method without body
    """public class C@ID@ {
    private Connection c;
    public C@ID@(String who) throws Exception {
        c.createStatement().execute("UPDATE t SET a=" + who);
    }
    interface Inner { void noBody(); }
}
""",
    # 15 broken structure
    """public class C@ID@ {
    public void bad( {
    }
}
""",
    # 16 methods behind deep, annotated and bounded type arguments, and with dimensions behind the parameters
    """public class C@ID@ {
    Map<String, Map<String, Map<String, List<String>>>> deep() {
        return null;
    }
    List<@NonNull String> noted() {
        return null;
    }
    <T extends Number & Comparable<T>> int cells()[] {
        return new int[0];
    }
    Map<@Size(max = 3, message = "a<b") String, @NonNull List<int[]>> sized() {
        return n < 3 ? null : m > 4 ? one : two;
    }
    A<A<A<A<A<A<A<A<A<A<A<String>>>>>>>>>>> piled() {
        return null;
    }
}
""",
    # 17 SQL beside the braces of an array; a path that rules and signature see
    """public class C@ID@ {
    public void list(Statement st, String a) throws Exception {
        st.execute("select " + String.join(",", new String[]{a, "b"}));
        File f = new File("/up/" + a);
    }
}
""",
    # 18 an else that belongs to the if around the loop
    """public class C@ID@ {
    public String tail(int n) {
        String out = "";
        if (n > 0) for (int i = 0; i < n; i++) out += "x"; else out += "y";
        return out;
    }
}
""",
    # 19 a method of one line
    """public class C@ID@ {
    void m(Statement st, String a) { st.execute("select " + a); }
}
""",
    # 20 a secret in the comment of a method
    """public class C@ID@ {
    /** Example: password = "letmein1" */
    public void help() {
        show();
    }
}
""",
    # 21 many weak methods
    "public class C@ID@ {\n" + "".join(f"""    public String p{i}(HttpServletRequest q) {{
        return q.getParameter("k").trim();
    }}
""" for i in range(WEAK_METHODS)) + "}\n",
    # 22 an unchecked optional inside a switch; a text block and a lambda without weakness
    """public class C@ID@ {
    int pick(Optional<String> o, int n) {
        switch (n) { case 1: return o.get().length(); default: return 0; }
    }
    public void each(List<String> xs) {
        String q = \"\"\"
            drop {"a"}
            \"\"\";
        xs.forEach(x -> { step(x); });
    }
}
""",
]

N_TEMPLATES = len(TEMPLATES)


def template_table(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(TEMPLATES))
    return spark.createDataFrame(rows, "t int, template string")


def java_corpus(documents: DataFrame) -> DataFrame:
    """(file_id, file_name, src, size_bytes) with one file per document."""
    spark = documents.sparkSession
    header = F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("")), F.lit(" */\n"))
    body = F.replace(F.col("template"), F.lit("@ID@"), F.col("doc_id").cast("string"))
    return (
        documents.select("doc_id", "text", F.pmod("doc_id", F.lit(N_TEMPLATES)).cast("int").alias("t"))
        # one row per template, fixed: always small enough to broadcast
        .join(F.broadcast(template_table(spark)), "t")
        .select(
            F.col("doc_id").alias("file_id"),
            F.concat(F.lit("C"), F.col("doc_id").cast("string"), F.lit(".java")).alias("file_name"),
            F.concat(header, body).alias("src"),
        )
        .withColumn("size_bytes", F.octet_length("src").cast("int"))
    )
