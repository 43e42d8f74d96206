"""tabloom.operators"""
