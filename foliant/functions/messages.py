"""User-facing texts of block decisions, by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Message texts by key for each language.
KEYS = [
    "prompt_blocked", "prompt_blocked_detail", "response_blocked", "server_error",
    "upstream_error", "server_busy", "request_timeout", "queue_full",
]
TEXTS = {
    "en": [
        "Your input was blocked by the security scanner. Reason: {reason}",
        "Input contains unsafe content and cannot be processed.",
        "Model output was blocked by the security scanner.",
        "Internal server error.",
        "Upstream service error.",
        "Server is currently busy processing other requests. Please try again later.",
        "Request timed out. Please try again with a shorter prompt or later.",
        "Request queue is full. Server is currently overloaded.",
    ],
    "zh": [
        "您的输入因安全扫描被阻止。原因：{reason}", "输入包含不安全内容，无法处理。", "模型输出被安全扫描阻止。", "内部服务器错误。",
        "上游服务发生错误。", "服务器正忙，请稍后再试。", "请求超时，请稍后或缩短提示重试。", "请求队列已满，服务器过载。",
    ],
    "vi": [
        "Yêu cầu của bạn đã bị chặn bởi trình quét bảo mật. Lý do: {reason}", "Nội dung không an toàn nên không thể xử lý.",
        "Phản hồi bị chặn bởi trình quét bảo mật.", "Lỗi máy chủ nội bộ.", "Dịch vụ thượng nguồn gặp lỗi.",
        "Máy chủ đang bận, vui lòng thử lại sau.", "Yêu cầu quá thời gian. Hãy thử lại sau hoặc rút ngắn nội dung.",
        "Hàng đợi yêu cầu đã đầy, máy chủ đang quá tải.",
    ],
    "ja": [
        "セキュリティスキャナーにより入力がブロックされました。理由: {reason}", "入力に安全でない内容が含まれているため処理できません。",
        "モデルの出力がセキュリティスキャナーによりブロックされました。", "サーバー内部エラーが発生しました。", "上流サービスでエラーが発生しました。",
        "サーバーが混雑しています。しばらくしてから再試行してください。", "タイムアウトしました。後でもう一度、または短いプロンプトでお試しください。",
        "リクエストキューが満杯です。",
    ],
    "ko": [
        "보안 스캐너가 입력을 차단했습니다. 이유: {reason}", "입력에 안전하지 않은 내용이 포함되어 처리할 수 없습니다.",
        "모델 출력이 보안 스캐너에 의해 차단되었습니다.", "내부 서버 오류가 발생했습니다.", "업스트림 서비스 오류가 발생했습니다.",
        "서버가 바쁘므로 잠시 후 다시 시도하세요.", "요청 시간이 초과되었습니다. 프롬프트를 줄이거나 나중에 다시 시도하세요.",
        "요청 대기열이 가득 차 서버가 과부하 상태입니다.",
    ],
    "ru": [
        "Ваш ввод заблокирован системой безопасности. Причина: {reason}", "Ввод содержит небезопасный контент и не может быть обработан.",
        "Выход модели заблокирован системой безопасности.", "Внутренняя ошибка сервера.", "Ошибка во внешнем сервисе.",
        "Сервер занят. Попробуйте позже.", "Время ожидания истекло. Попробуйте ещё раз позже или сократите запрос.",
        "Очередь запросов заполнена. Сервер перегружен.",
    ],
    "ar": [
        "تم حظر الإدخال بواسطة فحص الأمان. السبب: {reason}", "يحتوي الإدخال على محتوى غير آمن ولا يمكن معالجته.",
        "تم حظر مخرجات النموذج بواسطة فحص الأمان.", "حدث خطأ داخلي في الخادم.", "حدث خطأ في الخدمة الخارجية.",
        "الخادم مشغول حاليًا. يرجى المحاولة لاحقًا.", "انتهت مهلة الطلب. حاول مجددًا لاحقًا أو استخدم مطالبة أقصر.",
        "قائمة الانتظار ممتلئة. الخادم مثقل بالطلبات.",
    ],
    "fr": [
        "Votre requête a été bloquée par le scanner de sécurité. Raison : {reason}",
        "La requête contient un contenu dangereux et ne peut pas être traitée.",
        "La réponse du modèle a été bloquée par le scanner de sécurité.", "Erreur interne du serveur.",
        "Erreur du service en amont.", "Le serveur est occupé. Veuillez réessayer plus tard.",
        "Délai dépassé. Réessayez plus tard ou réduisez votre requête.", "La file d’attente est pleine. Le serveur est surchargé.",
    ],
    "de": [
        "Ihre Eingabe wurde vom Sicherheitsscanner blockiert. Grund: {reason}",
        "Die Eingabe enthält unsichere Inhalte und kann nicht verarbeitet werden.",
        "Die Modellausgabe wurde vom Sicherheitsscanner blockiert.", "Interner Serverfehler.", "Fehler beim Upstream-Dienst.",
        "Server ausgelastet. Bitte später erneut versuchen.",
        "Zeitüberschreitung. Versuchen Sie es später erneut oder verkürzen Sie die Eingabe.",
        "Die Anfragenwarteschlange ist voll. Server überlastet.",
    ],
    "es": [
        "Tu entrada fue bloqueada por el escáner de seguridad. Razón: {reason}",
        "La entrada contiene contenido inseguro y no puede procesarse.",
        "La salida del modelo fue bloqueada por el escáner de seguridad.", "Error interno del servidor.",
        "Error en el servicio ascendente.", "El servidor está ocupado. Inténtalo de nuevo más tarde.",
        "La solicitud agotó el tiempo. Intenta nuevamente más tarde o usa un mensaje más corto.",
        "La cola de solicitudes está llena. El servidor está sobrecargado.",
    ],
    "pt": [
        "Sua entrada foi bloqueada pelo verificador de segurança. Motivo: {reason}",
        "A entrada contém conteúdo inseguro e não pode ser processada.",
        "A saída do modelo foi bloqueada pelo verificador de segurança.", "Erro interno do servidor.",
        "Erro no serviço upstream.", "Servidor ocupado. Tente novamente mais tarde.",
        "Tempo limite atingido. Tente novamente mais tarde ou reduza o prompt.",
        "A fila de solicitações está cheia. Servidor sobrecarregado.",
    ],
}

# Short notices by error class.
NOTICES = {
    "scanner_invalid": "🛡️ **Content Blocked**: Your message violates safety guidelines.",
    "inappropriate": "⚠️ **Inappropriate Content**: Please revise your message.",
    "threat_detected": "🚨 **Security Alert**: Potential threat detected.",
    "timeout": "⏱️ **Timeout Error**: Request timed out.",
    "generic": "⚠️ Content Security Alert: Your request has been blocked by our content safety filters.",
}
ADVICE = "> Please review the input and try again after removing the flagged content."


def message_table(spark: SparkSession) -> DataFrame:
    rows = [(lang, key, text) for lang, texts in TEXTS.items() for key, text in zip(KEYS, texts)]
    return spark.createDataFrame(rows, "language string, message_key string, message string")


def localized(df: DataFrame, key: str, language: str = "language", reason: str | None = None, out: str = "message") -> DataFrame:
    """Add the message of ``key`` in the row's language, English where there is none.

    The message table has a fixed 88 rows, so it is broadcast.
    """
    texts = message_table(df.sparkSession).where(F.col("message_key") == key)
    texts = texts.select(F.col("language").alias("_lang"), F.col("message").alias("_text"))
    english = TEXTS["en"][KEYS.index(key)] if key in KEYS else ""
    joined = df.join(F.broadcast(texts), F.col(language) == F.col("_lang"), "left")
    text = F.coalesce(F.col("_text"), F.lit(english))
    if reason is not None:
        given = F.coalesce(F.col(reason), F.lit("")) != ""
        text = F.when(given, F.replace(text, F.lit("{reason}"), F.col(reason))).otherwise(text)
    return joined.withColumn(out, text).drop("_lang", "_text")


def score_percent(score: Column) -> Column:
    """``50.0%``; scores up to one are shares, above they are percent already."""
    percent = F.least(F.greatest(F.when(score > 1, score).otherwise(score * 100), F.lit(0.0)), F.lit(100.0))
    return F.when(score.isNull(), "-").otherwise(F.concat(F.format_string("%.1f", percent), F.lit("%")))


def markdown_report(title: str, description: Column, failed: Column) -> Column:
    """Report of a block decision; ``failed`` is array<struct<scanner, reason, score>>."""
    # The heads of the table.
    row = lambda s: F.concat(
        F.lit("| "), s["scanner"], F.lit(" | "), s["reason"], F.lit(" | "), score_percent(s["score"]), F.lit(" |"))
    has_text = F.coalesce(description, F.lit("")) != ""
    lines = F.concat(
        F.array(F.lit(f"### {title}")),
        F.when(has_text, F.array(F.lit(""), description)).otherwise(F.array().cast("array<string>")),
        F.when(F.size(failed) > 0, F.concat(
            F.array(F.lit(""), F.lit("| Scanner | Reason | Score (%) |"), F.lit("| --- | --- | --- |")),
            F.transform(failed, row))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit(ADVICE)),
    )
    return F.array_join(lines, "\n")


def error_class(message: Column) -> Column:
    """Class of a block message by its words, in fixed order."""
    # The words of each class.
    low = F.lower(message)
    return (
        F.when(F.coalesce(message, F.lit("")) == "", "generic")
        .when(low.rlike("content policy|safety guidelines|guardrails|content blocked"), "scanner_invalid")
        .when(low.rlike("scanner|invalid|block|unsafe|unavailable for legal reasons"), "scanner_invalid")
        .when(low.contains("inappropriate"), "inappropriate")
        .when(low.rlike("threat|security|malicious"), "threat_detected")
        .when(low.rlike("timeout|timed out"), "timeout")
        .otherwise("generic")
    )


def notice(kind: Column, style: str = "markdown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in NOTICES.items() for x in pair])
    text = F.coalesce(F.element_at(table, kind), F.lit(NOTICES["generic"]))
    if style == "html":  # fixed value: the frame of the notice
        return F.concat(F.lit('<div style="color: #dc3545; padding: 10px;">'), text, F.lit("</div>"))
    return F.concat(F.lit("ERROR: " if style == "plain" else "> "), text)


def is_block_event(payload: Column) -> Column:
    """A JSON object or text that reports a block for legal or policy reasons (status 451)."""
    # Names of the fields and words of the text.
    field = lambda name: F.get_json_object(payload, f"$.{name}")
    policy = F.coalesce(F.nullif(F.get_json_object(payload, "$['X-Error-Type']"), F.lit("")), field("error_type"))
    low = F.lower(payload)
    plain = ~F.ltrim(payload).startswith("{") & payload.contains("451") & low.rlike("unavailable|legal|blocked|content policy")
    said = lambda test: F.coalesce(test, F.lit(False))
    return (
        said(field("status_code") == "451") | said(field("status") == "451") | said(plain)
        | said(policy == "content_policy_violation")
    )


def rewrite_events(events: DataFrame, payload: str, style: str = "markdown") -> DataFrame:
    """Put a notice in place of block events and leave all others as they are.

    Works on batch and streaming frames alike.
    """
    body = F.col(payload)
    message = F.coalesce(
        F.nullif(F.get_json_object(body, "$.error"), F.lit("")), F.nullif(F.get_json_object(body, "$.detail"), F.lit("")), body)
    out = events.withColumn("blocked", is_block_event(body))
    out = out.withColumn("kind", F.when(F.col("blocked"), error_class(message)))
    return out.withColumn("shown", F.when(F.col("blocked"), notice(F.col("kind"), style)).otherwise(body))
