Table	Create Table
shop_country	CREATE TABLE "shop_country" (\n  "country" char(2) NOT NULL,\n  "country_code" varchar(2) DEFAULT NULL,\n  "country_name" varchar(64) DEFAULT NULL,\n  PRIMARY KEY ("country")\n)
