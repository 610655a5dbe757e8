Table	Create Table
shop_log	CREATE TABLE "shop_log" (\n  "message" longtext,\n  "level" varchar(8) DEFAULT 'INFO',\n  "seen" timestamp NOT NULL DEFAULT CURRENT_TIMESTAMP\n)
