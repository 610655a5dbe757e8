Table	Create Table
shop_token	CREATE TABLE "shop_token" (\n  "token_uuid" char(36) NOT NULL,\n  "ref_guid" char(32) DEFAULT NULL,\n  "secret" char(36) DEFAULT NULL,\n  PRIMARY KEY ("token_uuid")\n)
