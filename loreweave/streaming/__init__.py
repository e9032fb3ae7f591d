"""loreweave.streaming"""
